"""Quality grades of texts: a cumulative-link (proportional odds) model over hashed words and word shapes.

All grades share one weight for each hashed feature; ordered thresholds part the grades: P(grade > k) = 1 / (1 + exp(threshold_k - weights x features)).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import textvec as V
from chronofold.llm.common import col, documents, forget, map_arrow, small_batches, written
from chronofold.llm.grams import held_out
from chronofold.llm.toxicity import MOST_LABELS

_U = np.uint64
#: Kinds of bytes: A-Z, a-z, digits and bytes of longer UTF-8 sequences are one each; every other byte is its own.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = 65, 97, 48, 128


@dataclass(frozen=True)
class QualityModel:
    """grades in order; weight: one for each bucket; threshold: one between each two neighbouring grades, ascending."""

    grades: tuple[int, ...]
    weight: np.ndarray
    threshold: np.ndarray
    bits: int


def _words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, hash of the word, hash of its shape, runs of a kind of byte being one) of every word, for groups of whole texts."""
    kept: list[tuple[np.ndarray, ...]] = []
    last = -1
    for data, at, rows in V.parts(texts):
        start, end = V.spans(data, V.WHITE)
        row = rows[np.searchsorted(at, start, "right") - 1]
        shape = SHAPE[data]
        new = np.concatenate([[True], (shape[1:] != shape[:-1]) | V.WHITE[data[1:]]])
        place = np.concatenate([[0], np.cumsum(new)])
        if kept and rows[0] != last:
            yield tuple(map(np.concatenate, zip(*kept)))
            kept = []
        kept.append((row, V.hashes(data, start, end, fold=True), V.hashes(shape[new], place[start], place[end], fold=False)))
        last = rows[-1]
    if kept:
        yield tuple(map(np.concatenate, zip(*kept)))


def features(texts: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket, value) of words, shapes and pairs of neighbouring shapes of each text: log(1 + count), scaled to length 1."""
    for row, word, shape in _words(texts):
        two = np.flatnonzero(row[1:] == row[:-1])
        pair = V.mix(shape[two] * _U(0x9DDFEA08EB382D69) + shape[two + 1])
        hashed = np.concatenate([V.mix(word + _U(1)), V.mix(shape + _U(2)), V.mix(pair + _U(3))]) >> _U(64 - bits)
        key, count = np.unique(np.concatenate([row, row, row[two]]) << bits | hashed.astype(np.int64), return_counts=True)
        of, value = key >> bits, np.log1p(count)
        norm = np.sqrt(np.bincount(of, value * value)) if len(of) else np.ones(1)
        yield of, key & ((1 << bits) - 1), value / norm[of]


def probabilities(z: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """P(grade > k) of each text for each threshold, between columns of 1 and 0."""
    above = 1 / (1 + np.exp(-np.clip(z[:, None] - threshold, -30, 30)))
    return np.concatenate([np.ones((len(z), 1)), above, np.zeros((len(z), 1))], axis=1)


def _loss(z: np.ndarray, y: np.ndarray, threshold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of -log P(grade), and its derivatives by each z and by each threshold."""
    above = probabilities(z, threshold)
    one = np.arange(len(y))
    high, low = above[one, y], above[one, y + 1]
    p = np.maximum(high - low, 1e-12)
    up, down = high * (1 - high) / p, low * (1 - low) / p
    by = np.bincount(y, up, len(threshold) + 1)[1:] - np.bincount(y, down, len(threshold) + 1)[:-1]
    return float(-np.log(p).sum()), down - up, by


def _least(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, close: float = 1e-5, memory: int = 8) -> np.ndarray:
    """L-BFGS with halved steps."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, held = g.copy(), []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            d -= a * y
            held.append(a)
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(g), 1e-12)
        for (s, y), a in zip(past, reversed(held)):
            d += s * (a - (y @ d) / (s @ y))
        size = 1.0
        while True:
            after, ga = f(x - size * d)
            if after <= value - 1e-4 * size * (g @ d) or size < 1e-4:
                break
            size /= 2
        if after >= value:
            break
        s, y = -size * d, ga - g
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)]
        done = value - after < close * abs(after)
        x, value, g = x + s, after, ga
        if done:
            break
    return x


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", bits: int = 16, ridge: float = 1e-4, steps: int = 40) -> QualityModel:
    """Learn from all labelled texts that aren't held out, whatever whole numbers the grades are.

    Each step of the fit is one job over all of them that sums the loss and its gradient; the driver has 2^bits weights. Of several labels of
    a document the highest counts. With one grade there is no threshold; without any, nothing is predicted.
    """
    spark = docs.sparkSession
    truth = labels.select(col("doc_id").cast("long").alias("doc_id"), col(label_col).cast("int").alias("grade")).where("grade is not null")
    truth = truth.groupBy("doc_id").agg(F.max("grade").alias("grade")).where(~held_out(F.col("doc_id")))
    few = truth.count() <= MOST_LABELS
    rows = documents(docs).where(~held_out(F.col("doc_id"))).join(F.broadcast(truth) if few else truth, "doc_id").select("grade", "text")

    def make():
        def each(batch: pa.RecordBatch):
            found = [*features(batch.column("text"), bits)]
            row, at, value = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield {"grade": batch.column("grade"), "at": pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), "value": pa.ListArray.from_arrays(offsets, pa.array(value, pa.float32()))}

        return each

    table = written(map_arrow(rows, make, "grade int, at array<int>, value array<float>"), "features")
    share = {r["grade"]: r["n"] for r in table.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    grades, total = tuple(sorted(share)), sum(share.values())
    buckets, cuts = 1 << bits, max(len(grades) - 1, 0)
    if not cuts:
        return QualityModel(grades, np.zeros(buckets), np.zeros(0), bits)
    above = np.array([sum(share[g] for g in grades[k + 1 :]) for k in range(cuts)], float)
    first = -np.log(above / (total - above))
    kind = pa.schema([("slot", pa.int32()), ("g", pa.float64())])

    def sums(w: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """Gradient by weights and thresholds, then the loss, over all rows."""
        shared = spark.sparkContext.broadcast((w, threshold))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, threshold = shared.value
            out = np.zeros(buckets + cuts + 1)
            for batch in batches:
                y = np.searchsorted(grades, batch.column("grade").to_numpy())
                row = np.repeat(np.arange(len(y)), batch.column("at").value_lengths().to_numpy())
                at, value = batch.column("at").flatten().to_numpy(), batch.column("value").flatten().to_numpy()
                loss, by_z, by_cut = _loss(np.bincount(row, w[at] * value, len(y)), y, threshold)
                out[:buckets] += np.bincount(at, by_z[row] * value, buckets)
                out[buckets:-1] += by_cut
                out[-1] += loss
            some = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out[some])], schema=kind)

        small_batches(spark)
        found = table.mapInArrow(run, "slot int, g double").groupBy("slot").agg(F.sum("g").alias("g")).toArrow()  # 2^bits rows and a few at most
        shared.unpersist()
        out = np.zeros(buckets + cuts + 1)
        out[found["slot"].to_numpy()] = found["g"].to_numpy()
        return out

    def thresholds(x: np.ndarray) -> np.ndarray:
        return x[0] + np.concatenate([[0.0], np.cumsum(np.exp(x[1:]))])

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, own = x[:buckets], x[buckets:]
        found = sums(w, thresholds(own)) / total
        by = found[buckets:-1]
        g = np.concatenate([found[:buckets] + ridge * w, [by.sum()], np.cumsum(by[::-1])[::-1][1:] * np.exp(own[1:])])
        return float(found[-1] + ridge / 2 * (w @ w)), g

    x = _least(f, np.concatenate([np.zeros(buckets), first[:1], np.log(np.diff(first))]), steps)
    forget(table)
    return QualityModel(grades, x[:buckets], thresholds(x[buckets:]), bits)


def score(docs: DataFrame, model: QualityModel, good: int | None = None) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_prob, predicted of every row.

    tail_prob is the probability of grade `good` (the highest, if none is given) or better, predicted the median grade. Null and empty texts have
    no features, so the thresholds alone decide; all three are null if nothing could be learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        grades = np.array(m.grades)
        tail = len(grades) - 1 if good is None else int(np.searchsorted(grades, good))

        def each(batch: pa.RecordBatch):
            n = batch.num_rows
            if not len(grades):
                yield {"doc_id": batch.column("doc_id"), **{c: [None] * n for c in ("expected_grade", "tail_prob", "predicted")}}
                return
            z = np.zeros(n)
            if len(m.threshold):
                for row, at, value in features(batch.column("text"), m.bits):
                    z += np.bincount(row, m.weight[at] * value, n)
            above = probabilities(z, m.threshold)
            yield {"doc_id": batch.column("doc_id"), "expected_grade": (above[:, :-1] - above[:, 1:]) @ grades, "tail_prob": above[:, tail], "predicted": grades[(above[:, 1:-1] >= 0.5).sum(axis=1)]}

        return each

    out = map_arrow(documents(docs), make, "doc_id long, expected_grade double, tail_prob double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_prob", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
