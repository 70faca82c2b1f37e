"""Harmonic packing of token documents into fixed sequences.

A length belongs to the reciprocal class k = capacity // length: k pieces of that length fill a bin. Documents are cut so that
nearly all pieces have exactly the size of a class, capacity / 2^j; what is left under the least size is one last piece. A bin
takes k pieces of one length, so bins are filled without regard to each other: a piece's bin and place follow from its number
among those of its length, which is a prefix sum over the counts of the written parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import documents, local_table, map_arrow, written
from chronofold.llm.encode import crc, encoder, word_tokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, number long"


def cuts(total: int, capacity: int, least: int) -> list[int]:
    """Lengths of the pieces of a document: whole bins, then halves, quarters ... down to the least size, then the rest."""
    out = [capacity] * (total // capacity)
    rest, size = total % capacity, capacity // 2
    while rest and size >= least:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def leftovers(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(length, index, bin, place) of the pieces that fill no bin of their class: fewer than capacity // length of each length.

    counts: how many such pieces each length has. First fit by falling length; several classes share these last bins.
    """
    room: list[int] = []
    out = []
    for length in sorted(counts, reverse=True):
        for i in range(counts[length]):
            at = next((b for b, r in enumerate(room) if r >= length), len(room))
            if at == len(room):
                room.append(capacity)
            out.append((length, i, at, capacity - room[at]))
            room[at] -= length
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, least: int = 64, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    Each document's ids (a null text: none) and the end id lie in exactly one piece each. A null doc_id, and repeated rows, are
    documents like others. Empty tables give no rows. Padding: at most capacity mod k in each bin, and the last, mixed bins.
    """
    spark = docs.sparkSession
    path = tokenizer or word_tokenizer()

    def make():
        words = encoder(path)
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        seen: dict[int, int] = {}

        def each(batch: pa.RecordBatch):
            names = [f.name for f in map_fields]
            out = {n: [] for n in names}
            doc_ids = batch.column("doc_id").to_pylist()
            for i, ids in words.documents(batch.column("text"), end_id):
                start = 0
                for length in cuts(len(ids), capacity, least):
                    seen[length] = seen.get(length, 0) + 1
                    for name, v in zip(names, (doc_ids[i], start, length, crc(ids[start : start + length]), len(ids), part, seen[length] - 1)):
                        out[name].append(v)
                    start += length
            yield out

        return each

    from pyspark.sql.types import StructType

    map_fields = StructType.fromDDL(PIECES)
    pieces = written(map_arrow(documents(docs, id_col, text_col), make, PIECES), "pieces")
    # One row for each length and part; the prefix sums run in one window for each length.
    sums = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    numbered = pieces.join(sums.select("length", "part", base.alias("base")), ["length", "part"]).withColumn("number", F.col("base") + F.col("number"))
    # log2(capacity) + least lengths at most, whatever the input; so are the tables made of them.
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    first, bins = [], 0
    for length in sorted(totals, reverse=True):
        k = capacity // length
        first.append((length, k, bins, totals[length] // k * k))
        bins += totals[length] // k
    open_ = {length: totals[length] - full for length, _, _, full in first}
    places = [(length, full + i, bins + at, place) for (length, _, _, full) in first for (x, i, at, place) in leftovers(open_, capacity) if x == length]
    starts = local_table(spark, first, "length long, k long, first long, full long")
    extra = local_table(spark, places, "length long, number long, at long, place long")
    return (
        numbered.join(F.broadcast(starts), "length")
        .join(F.broadcast(extra), ["length", "number"], "left")
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            F.coalesce("at", F.expr("first + number div k")).alias("sequence_id"),
            F.coalesce("place", F.expr("number % k * length")).alias("offset"),
        )
    )


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
