"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams, FTRL-proximal with an elastic net, then temperature calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import grams as G
from chronofold.llm.common import documents, map_arrow, small_batches


@dataclass(frozen=True, eq=False)
class LanguageModel:
    """A text's logits: the mean over its n-grams of idf * weight, plus bias, divided by the temperature."""

    languages: tuple[str, ...]
    weight: np.ndarray  # a row for each bucket, idf included
    bias: np.ndarray
    temperature: float
    least: int
    most: int
    bits: int


def _document_counts(rows: DataFrame, least: int, most: int, bits: int) -> tuple[np.ndarray, int]:
    """How many texts have each bucket, and how many texts there are; each task sends one sum."""
    kind = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, gram in G.gram_store(least, most, bits).distinct(batch.column("text"), 1 << bits):
                total[gram] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], schema=kind)

    small_batches(rows.sparkSession)
    found = rows.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # 2^bits + 1 rows at most
    out = np.zeros((1 << bits) + 1, np.int64)
    out[found["gram"].to_numpy()] = found["n"].to_numpy()
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, lang_col: str = "lang", least: int = 1, most: int = 3, bits: int = 16, sample: int = 4_000, each_least: int = 100, passes: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> LanguageModel | None:
    """Learn from the texts with a language that aren't held out; None if there are none.

    Document frequencies come from all of them. The regression sees about `sample` rows, those whose hash of the id is under a limit, and of
    each language about `each_least` (all, if fewer), however rare it is; a fifth of them sets the temperature. That bound is the only one.
    """
    rows = documents(docs).select("doc_id", "text").withColumn("lang", F.lit(None).cast("string")) if lang_col not in docs.columns else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(~G.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(many))
    if not languages:
        return None
    seen, n = _document_counts(rows, least, most, bits)
    idf = np.log((1 + n) / (1 + seen)) + 1
    limit = {x: int((1 << 30) * min(1.0, max(sample / max(n, 1), each_least / m))) for x, m in many.items()}
    limits = docs.sparkSession.createDataFrame(list(limit.items()), "lang string, most long")  # a row for each language
    few = rows.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("most")).select("doc_id", "text", "lang")
    code = {x: i for i, x in enumerate(languages)}

    def make():
        def each(batch: pa.RecordBatch):
            grams, times = ([[]] * batch.num_rows for _ in range(2))
            for row, gram, many in G.distinct(batch.column("text"), least, most, bits):
                edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    grams[row[a]], times[row[a]] = gram[a:b], many[a:b]
            yield {"y": [code[x] for x in batch.column("lang").to_pylist()], "gram": pa.array(grams, pa.list_(pa.int32())), "times": pa.array(times, pa.list_(pa.float32()))}

        return each

    data = map_arrow(few, make, "y int, gram array<int>, times array<float>").toArrow().combine_chunks()
    grams, times = (data[c].combine_chunks() for c in ("gram", "times"))
    stop = np.cumsum(grams.value_lengths().to_numpy()).tolist()
    grams, times = grams.flatten().to_numpy(), times.flatten().to_numpy()
    examples = [(y, grams[a:b], times[a:b] / times[a:b].sum() * idf[grams[a:b]]) for y, a, b in zip(data["y"].to_pylist(), [0, *stop], stop) if b > a]
    order = np.random.default_rng(5).permutation(len(examples))
    apart = order[: len(order) // 5] if len(order) >= 50 else order
    weight, bias = _ftrl([examples[i] for i in order[len(order) // 5 if len(order) >= 50 else 0 :]], 1 << bits, len(languages), passes, alpha, beta, l1, l2)
    temperature = _temperature([(examples[i][0], bias + examples[i][2] @ weight[examples[i][1]]) for i in apart])
    return LanguageModel(languages, (weight * idf[:, None]).astype(np.float32), bias, temperature, least, most, bits)


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(examples, buckets: int, classes: int, passes: int, alpha: float, beta: float, l1: float, l2: float):
    """FTRL-proximal, one text at a time: weights with |z| under l1 are zero, others are shrunk by l2 and their own step size."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(passes):
        for y, gram, value in examples:
            at, x = np.append(gram, buckets), np.append(value, 1.0)
            w = weights(at)
            miss = _soft(x @ w)
            miss[y] -= 1
            g = x[:, None] * miss
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def _temperature(pairs) -> float:
    """The divisor of the logits with the least log loss on texts that the regression hasn't seen."""
    if not pairs:
        return 1.0
    y, logits = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    tried = np.exp(np.linspace(np.log(0.02), np.log(20), 140))
    loss = [-np.log(_soft(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


@lru_cache(2)
def _sums(m: LanguageModel) -> G.WordStore:
    """Sums of the weights of each word's n-grams, by language, and how many n-grams it has; kept for as many tasks of a Python worker as have the model."""

    def make(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        gram, size = G.word_grams(words, m.least, m.most, m.bits)
        begin = np.minimum(np.cumsum(size) - size, max(len(gram) - 1, 0))
        sums = np.where(size[:, None] > 0, np.add.reduceat(m.weight[gram].astype(float), begin, axis=0), 0.0)
        return np.column_stack([sums, size]), np.ones(len(size), np.int64)

    return G.WordStore(make)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; `und` with score 0 if the text is null or has no letter, or nothing could be learned."""
    rows = documents(docs)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    if model is None:
        return rows.select("doc_id", G.held_out(F.col("doc_id")).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        known_words = _sums(m)

        def each(batch: pa.RecordBatch):
            total, many = np.zeros((batch.num_rows, len(m.languages))), np.zeros(batch.num_rows)
            for row, slot, times in known_words.words(batch.column("text")):
                value = known_words.values[known_words.at[slot]] * times[:, None]
                many += np.bincount(row, value[:, -1], batch.num_rows)
                for c in range(len(m.languages)):
                    total[:, c] += np.bincount(row, value[:, c], batch.num_rows)
            p = _soft((total / np.maximum(many, 1)[:, None] + m.bias) / m.temperature)
            best = p.argmax(axis=1)
            known = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            names = np.array([*m.languages, "und"], object)
            yield {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names[np.where(known, best, len(m.languages))], pa.string()), "score": np.where(known, p[np.arange(len(p)), best], 0.0)}

        return each

    out = map_arrow(rows.select("doc_id", "text", lettered), make, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", G.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
