"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import grams as G
from chronofold.llm.common import col, documents, map_arrow, small_batches, stored


#: Labels that are broadcast (some 16 MB); more are joined by a shuffle.
MOST_LABELS = 500_000


@dataclass(frozen=True, eq=False)
class ToxicityModel:
    """gram: sorted buckets with a weight; weight: log-count ratio times learned coefficient; a text scores 1 / (1 + exp(-(bias + sum)))."""

    gram: np.ndarray
    weight: np.ndarray
    bias: float
    least: int
    most: int
    bits: int


def _counts(rows: DataFrame, least: int, most: int, bits: int) -> DataFrame:
    """How many texts of either label have each bucket: one sum in each task, then one over tasks."""
    kind = pa.schema([("gram", pa.int32()), ("pos", pa.int64()), ("neg", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            label = batch.column("label").to_pylist()
            for row, gram in G.gram_store(least, most, bits).distinct(batch.column("text"), 1 << bits):
                total[label[row], gram] += 1
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((some, total[1][some], total[0][some]), kind.types)], schema=kind)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "gram int, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", least: int = 3, most: int = 6, bits: int = 20, sample: int = 10_000, clear: float = 4.0, smooth: float = 1.0, ridge: float = 1e-3, steps: int = 400) -> ToxicityModel:
    """Learn from the labelled texts that aren't held out.

    Log-count ratios come from the counts over all of them. Features are selected by their evidence: buckets whose ratio isn't `clear` standard
    errors from zero have weight zero, which with `clear=0` are none. The coefficients are fitted by logistic regression on about `sample` labelled rows, those whose hash of the
    id is under a limit; that bound is the only one. Rows with another label than 0 and 1 take no part; without rows of both, the
    model has a bias alone.
    """
    truth = labels.select(col("doc_id").cast("long").alias("doc_id"), col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    truth = truth.groupBy("doc_id").agg(F.max("label").alias("label")).where(~G.held_out(F.col("doc_id")))
    n = {r["label"]: r["n"] for r in truth.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = documents(docs).where(~G.held_out(F.col("doc_id"))).join(F.broadcast(truth) if sum(n.values()) <= MOST_LABELS else truth, "doc_id").select("doc_id", "label", "text")
    pos, neg = n.get(1, 0), n.get(0, 0)
    bias = float(np.log((pos + 0.5) / (neg + 0.5)))
    if not pos or not neg:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), bias, least, most, bits)
    p, q = F.col("pos") + smooth, F.col("neg") + smooth
    ratio = F.log(p / (pos + 2 * smooth)) - F.log(q / (neg + 2 * smooth))
    found = _counts(rows.select("text", "label"), least, most, bits).select("gram", ratio.alias("ratio"), (F.abs(ratio) / F.sqrt(1 / p + 1 / q)).alias("sure"))
    found = found.where(F.col("sure") >= clear).orderBy("gram").toArrow()  # 2^bits rows at most
    gram, ratio = found["gram"].to_numpy().astype(np.int64), found["ratio"].to_numpy()
    few = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / (pos + neg))))

    def make():
        number = np.full(1 << bits, -1, np.int32)
        number[gram] = np.arange(len(gram))

        def each(batch: pa.RecordBatch):
            held = [np.zeros(0, np.int32)] * batch.num_rows
            for i, g in G.gram_store(least, most, bits).distinct(batch.column("text"), 1 << bits):
                held[i] = np.sort(number[g[number[g] >= 0]])
            yield {"label": batch.column("label"), "at": pa.array(held, pa.list_(pa.int32()))}

        return each

    data = map_arrow(few.select("label", "text"), make, "label int, at array<int>").toArrow().combine_chunks()
    y = data["label"].to_numpy().astype(float)
    if not len(y):
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), bias, least, most, bits)
    lists = data["at"].combine_chunks()
    at, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    w, b = _logistic(size, at, ratio, y, bias, ridge, steps)
    return ToxicityModel(gram, ratio * w, b, least, most, bits)


def _sums(index: np.ndarray, start: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function of values: their sums by runs of an index, run i being index[start[i] : start[i + 1]]."""
    some = np.flatnonzero(start[1:] > start[:-1])

    def of(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start) - 1)
        if len(some):
            out[some] = np.add.reduceat(values[index], start[some])
        return out

    return of


def _logistic(size, at, ratio, y, bias, ridge, steps):
    """Coefficients of the scaled presence features, by Adam over all rows. size: features of each row; at: these features, row after row."""
    by_row = _sums(at, np.concatenate([[0], np.cumsum(size)]))
    order = np.argsort(at, kind="stable")
    row = np.repeat(np.arange(len(y), dtype=np.int32), size)[order]
    by_feature = _sums(row, np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(ratio)))]))
    del order
    w, b = np.full(len(ratio), 0.1), bias
    state = np.zeros((2, len(ratio) + 1))
    for t in range(1, steps + 1):
        z = b + by_row(ratio * w)
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate([by_feature(miss) * ratio / len(y) + ridge * w, [miss.mean()]])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        step = 0.03 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def scores(texts: pa.Array, m: ToxicityModel) -> np.ndarray:
    """The score of each text; null and empty texts have that of the bias alone."""
    z = np.full(len(texts), m.bias)
    if len(m.gram):
        for row, at in _weighted(m).distinct(texts, len(m.gram)):
            z[row] += m.weight[np.sort(at)].sum()
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, repeated rows included; null and empty texts have the score of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def each(batch: pa.RecordBatch):
            yield {"doc_id": batch.column("doc_id"), "score": scores(batch.column("text"), shared.value)}

        return each

    out = map_arrow(documents(docs), make, "doc_id long, score double")
    return out.select("doc_id", G.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@stored(2)
def _weighted(m: ToxicityModel) -> G.WordStore:
    """Numbers of the weighted buckets of each word; kept for as many tasks of a Python worker as have the model."""
    G.gram_store.cache_clear()  # fitting is over
    number = np.full(1 << m.bits, -1, np.int32)
    number[m.gram] = np.arange(len(m.gram))

    def make(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        gram, many = G.word_grams(words, m.least, m.most, m.bits)
        at = number[gram]
        owner = np.repeat(np.arange(len(many)), many)[at >= 0]
        return at[at >= 0], np.bincount(owner, minlength=len(many))

    return G.WordStore(make)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))


def clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns, whatever their names; rows may repeat, and null and empty texts have the bias's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(scores(text, shared.value))

    return docs.where(scored(col("text").cast("string")) < threshold)
