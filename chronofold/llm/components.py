"""Connected components of a table of links: by alternating large-star and small-star steps, or in one task where links are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import forget, written


#: Links (16 bytes each) that one task takes; more are worked on in star steps over all tasks.
FEW = 500_000


def _solve(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node that each reaches): every node takes the least label over its links, and labels are followed to their own, until none changes."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (label[a], label[b]):
            np.minimum.at(new, at, least)
        while (further := new[new] != new).any():
            new[further] = new[new[further]]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if held:
            nodes, least = _solve(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])

    return links.coalesce(1).mapInArrow(run, "node long, component long")


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) of every node that has a link. Nulls and links to itself count for nothing.

    Links stay in tables in the shared folder; the driver learns after each round whether only stars are left. A node with
    many links is only ever reduced by a minimum or joined to one row, so its links may lie in many tasks.
    """
    links = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    if links.count() <= FEW:
        return _in_one_task(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both).withColumn("m", F.least("m", "u")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        small = large.join(_least(large), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = written(small, "small-star")
        forget(links, large)
        links = small
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1").isEmpty():
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def extended(found: DataFrame, more: DataFrame) -> DataFrame:
    """found (node, component) with links (a, b) added to it; only the components that they join are worked on."""
    ends = more.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(found.select(F.col("node").alias(end), F.col("component").alias("of_" + end)), end, "left").withColumn("of_" + end, F.coalesce("of_" + end, end))
    nodes = found.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti").withColumn("component", F.col("node")))
    joined = written(components(ends, "of_a", "of_b"), "joined")
    return nodes.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
