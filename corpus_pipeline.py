"""A text corpus pipeline: each stage reads the whole table that the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import decontaminate, lines, near_duplicates, packing, toxicity
from chronofold.llm.common import drop_made, made_since, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't call toxic."""
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line, up to an edit, stays where it is first; a document that has no line left goes."""
    return lines.clean(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five words are similar to 0.8."""
    return near_duplicates.clean(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("minhash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: Learned scores, edit distances and tokens: SQL cannot express the stages; tests hold the rows of each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again; the work tables of a stage go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        with made_since() as made:
            found = apply(spark, docs, sf_dir)
        docs = written(found, f"stage-{name.replace(' ', '-')}")
        drop_made(spark, made)
    return docs
