"""Exact top-k by a Voronoi join: data grouped by pivots, bounds from group summaries, only groups that can matter searched for a query.

Pivots are rows of the data, about the square root of their number. A group's summary is the least and greatest distance of its rows from its pivot and their
greatest length. For a row x of a group with pivot p and a query q at a distance d from p, q.x is at most q.p + |q| |x - p|, and at most (|q|^2 + |x|^2 - g^2) / 2 where
g is how far d lies outside the group's range of distances. The k-th best score of q among the pivots of other ids is a score that its k-th result has
at least, so q goes only to groups whose bound isn't below. Queries are dealt by their own nearest pivot, and a share of them gets only the
groups that one of them needs. Groups are cut into blocks of bounded size, so that one which holds a large part of the data is searched in many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import col, map_arrow, written

#: Data rows that a task compares with queries at once, queries that it takes at once, and queries that share a copy of the groups they need.
BLOCK, QUERIES, SHARE = 4096, 1024, 8192
#: Pivots that every task gets.
MOST_PIVOTS = 2048


def _valid(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id and the vector of floor(scale * x) as doubles, without nulls, non-finite components, empty vectors and null ids."""
    v = F.transform(col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    out = rows.select(col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.transform(col(vector_col), lambda x: x.cast("double")).alias("raw"))
    return out.where(good & F.col("vec_id").isNotNull()).select("vec_id", "v")


def _pivots(rows: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of at most `count` rows with vectors that differ, drawn by a hash of the id."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(count * 4).collect()
    found = {tuple(r["v"]): r["vec_id"] for r in reversed(drawn)}
    chosen = list(found.items())[::-1][:count]
    if not chosen:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    return np.array([i for _, i in chosen], np.int64), _matrix([v for v, _ in chosen])


def _matrix(vectors, width: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones are padded with zeros."""
    width = max([width, *map(len, vectors)])
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: exact in doubles while they stay under 2^53, else by whole numbers."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    if width * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < 2**53:
        return (q @ x.T).astype(np.int64)
    return np.array([[sum(int(a) * int(b) for a, b in zip(i, j)) for j in x] for i in q], object)


@dataclass(frozen=True)
class Groups:
    """Data by pivot (cell, far, vec_id, v), and a summary of each group that has rows."""

    rows: DataFrame
    ids: np.ndarray  # of the pivots
    pivots: np.ndarray
    cell: np.ndarray
    near: np.ndarray
    far: np.ndarray
    length: np.ndarray
    size: np.ndarray


def groups(data: DataFrame, pivots: int | None = None) -> Groups:
    """Each row (vec_id, v) with its nearest pivot; a row for each pivot comes to the driver."""
    spark = data.sparkSession
    count = pivots or int(min(MOST_PIVOTS, max(32, data.count() ** 0.5)))
    ids, centre = _pivots(data, count)
    shared = spark.sparkContext.broadcast(centre)  # MOST_PIVOTS vectors at most

    def placed():
        def each(batch: pa.RecordBatch):
            x = _matrix(batch.column("v").to_pylist(), shared.value.shape[1])
            cell, far = _nearest(x, shared.value)
            yield {"cell": cell, "far": far, "length": np.sqrt((x * x).sum(axis=1)), "vec_id": batch.column("vec_id"), "v": batch.column("v")}

        return each

    cells = written(map_arrow(data, placed, "cell int, far double, length double, vec_id long, v array<double>"), "cells")
    found = cells.groupBy("cell").agg(F.min("far").alias("near"), F.max("far").alias("far"), F.max("length").alias("length"), F.count("*").alias("n")).orderBy("cell").collect()
    return Groups(cells.drop("length"), ids, centre, *(np.array([r[c] for r in found], k) for c, k in (("cell", np.int64), ("near", float), ("far", float), ("length", float), ("n", np.int64))))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(pivots, ((0, 0), (0, x.shape[1] - pivots.shape[1])))
    cell = ((p * p).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
    return cell, np.sqrt(((x - p[cell]) ** 2).sum(axis=1))


def needed(queries: DataFrame, g: Groups, k: int) -> DataFrame:
    """cell, home (the query's own nearest pivot), query_id, v: a row for each group that a query has to look at."""
    shared = queries.sparkSession.sparkContext.broadcast((g.ids, g.pivots, g.cell, g.near, g.far, g.length))

    def asked():
        ids, pivots, cells, near, far, length = shared.value

        def each(batch: pa.RecordBatch):
            if not len(cells):
                return
            q = _matrix(batch.column("v").to_pylist(), pivots.shape[1])
            own = batch.column("vec_id").to_numpy()
            p = np.pad(pivots, ((0, 0), (0, q.shape[1] - pivots.shape[1])))
            score = q @ p.T
            known = np.where(own[:, None] == ids, -np.inf, score)
            bound = -np.sort(-known, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(q), -np.inf)
            dot, square = score[:, cells], (q * q).sum(axis=1)[:, None]
            away = np.sqrt(np.maximum(square - 2 * dot + (p[cells] ** 2).sum(axis=1), 0))
            gap = np.maximum(np.maximum(away - far, near - away), 0)
            upper = np.minimum(dot + np.sqrt(square) * far, (square + length**2 - gap**2) / 2)
            slack = 1e-9 * (1 + square + length**2)  # rounding
            row, at = np.nonzero(upper + slack >= bound[:, None])
            yield {"cell": cells[at], "home": _nearest(q, pivots)[0][row], "query_id": batch.column("vec_id").take(pa.array(row)), "v": batch.column("v").take(pa.array(row))}

        return each

    return map_arrow(queries, asked, "cell int, home int, query_id long, v array<double>")


def top_k(data: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products over the other ids, ties to the smaller id.

    Vectors of unlike length are padded with zeros. A repeated id is a row of its own in the data and one query; a query never meets rows of its own id. Queries and data
    without a valid vector take no part; without data there are no rows. Scores must fit a long.
    """
    spark = data.sparkSession
    data = _valid(data, id_col, vector_col, scale)
    queries = _valid(queries, id_col, vector_col, scale).dropDuplicates(["vec_id"])
    g = groups(data, pivots)
    blocks = spark.createDataFrame([(int(c), int(-(-n // BLOCK))) for c, n in zip(g.cell, g.size)], "cell int, blocks int")
    # Queries of one nearest pivot are shared out by its own number and a hash, so that a share holds about SHARE of them that look at like groups.
    shares = max(1, -(-queries.count() // SHARE))
    per_home = max(1, -(-shares // max(len(g.cell), 1)))
    share = F.pmod(F.col("home"), F.lit(min(shares, max(len(g.cell), 1)))) * per_home + F.pmod(F.xxhash64("query_id"), F.lit(per_home))
    asked = written(needed(queries, g, k).withColumn("part", share.cast("long")), "asked")
    left = asked.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "part", "query_id", F.lit(None).cast("long").alias("vec_id"), "v")
    wanted = asked.select("cell", "part").distinct()
    right = g.rows.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    right = right.join(wanted, "cell").select("cell", "block", "part", F.lit(None).cast("long").alias("query_id"), "vec_id", "v")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        ask, have = group[group["query_id"].notna()], group[group["vec_id"].notna()].sort_values("vec_id")
        if not len(ask) or not len(have):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        ids = have["vec_id"].to_numpy(np.int64)
        x = _matrix(have["v"].tolist())
        out = []
        for a in range(0, len(ask), QUERIES):
            some = ask.iloc[a : a + QUERIES]
            score = _products(_matrix(some["v"].tolist()), x)
            for q, s in zip(some["query_id"].to_numpy(np.int64), score):
                other = ids != q
                s, i = s[other], ids[other]
                if len(s) > k and s.dtype != object:  # ids ascend, so a stable order keeps ties right
                    cut = np.partition(s, len(s) - k)[len(s) - k]
                    s, i = s[s >= cut], i[s >= cut]
                best = np.argsort(-s, kind="stable")[:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": i[best], "score": s[best].astype(np.int64)}))
        return pd.concat(out)

    local = left.unionByName(right).groupBy("cell", "block", "part").applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(data, data.where("vec_id % 50 = 0"))


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= 5
"""
