"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, components.

Texts with the same set are one class and only its least document goes on. Classes that share a band are candidates. A bucket isn't
spread into all its pairs. First each member is compared with one centre, the member whose buckets are the largest, which
in a group of copies is the same for nearly all buckets. Buckets whose members are then still in several components are compared in
full, in blocks of bounded size, leaving out pairs that are already in one component; that loses no link between components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import shingles as S
from chronofold.llm import textvec as V
from chronofold.llm.common import documents, forget, free, map_arrow, written
from chronofold.llm.components import components, extended

SIGNED = "doc_id long, n_shingles long, one long, two long, bands array<long>, sketch binary"
#: Coordinates, a byte each, that estimate a similarity before sets are fetched.
SKETCH = 256
#: Members of a bucket that one task compares with as many others, and bytes of their sets.
BLOCK, BLOCK_BYTES = 1000, 32 << 20
#: Ids that may be broadcast (8 MB); more are joined by a shuffle.
MOST_IDS = 1_000_000


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def make():
        def each(batch: pa.RecordBatch):
            n = np.zeros(batch.num_rows, np.int64)
            prints = np.zeros((2, batch.num_rows), np.uint64)
            keys, sketches = [None] * batch.num_rows, [None] * batch.num_rows
            for text, start, value in S.shingle_sets(batch.column("text"), width):
                n[text] = np.diff(np.append(start, len(value)))
                for k in (0, 1):
                    prints[k, text] = V.mix(np.add.reduceat(V.mix(value + np.uint64(k * 77 + 1)), start) + n[text].astype(np.uint64))
                signature = S.signatures(start, value, bands * rows)
                key = S.band_keys(signature, bands, rows).view(np.int64)
                short = np.ascontiguousarray(signature[:, :SKETCH].astype(np.uint8))
                for i, t in enumerate(text.tolist()):
                    keys[t], sketches[t] = key[i], short[i].tobytes()
            yield {"doc_id": batch.column("doc_id"), "n_shingles": n, "one": prints[0].view(np.int64), "two": prints[1].view(np.int64), "bands": pa.array(keys, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.binary())}

        return each

    return map_arrow(docs, make, SIGNED)


def _estimate(pairs: DataFrame, threshold: float, coordinates: int) -> DataFrame:
    """Pairs whose sketches are within seven standard errors of the threshold or above, for sketches of so many coordinates."""
    count = min(SKETCH, coordinates)
    limit = threshold - 7 * (threshold * (1 - threshold) / count) ** 0.5

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([bool(np.mean(np.frombuffer(p, np.uint8) == np.frombuffer(q, np.uint8)) >= limit) for p, q in zip(x, y)])

    return pairs.where(near("x", "y"))


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """node, n, elements (sorted 64-bit values as bytes) of the documents whose id is a node of ids."""
    few = ids.count() <= MOST_IDS
    wanted = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["node"], "left_semi")

    def make():
        def each(batch: pa.RecordBatch):
            held: list[bytes] = [b""] * batch.num_rows
            for text, start, value in S.shingle_sets(batch.column("text"), width):
                end = np.append(start[1:], len(value))
                for t, a, b in zip(text.tolist(), start.tolist(), end.tolist()):
                    held[t] = value[a:b].tobytes()
            yield {"node": batch.column("doc_id"), "n": [len(x) // 8 for x in held], "elements": pa.array(held, pa.binary())}

        return each

    return map_arrow(wanted, make, "node long, n long, elements binary").where("n > 0")


def _linked(n: int, m: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough."""
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("elements").alias("xa"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("xb"))
    sized = pairs.join(x.select("a", "na"), "a").join(y.select("b", "nb"), "b").where(F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"))

    @F.pandas_udf("boolean")
    def near(p: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(p, q):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            both = np.sort(np.concatenate([s, t]))
            out.append(_linked(len(s), len(t), int(np.count_nonzero(both[1:] == both[:-1])), percent))
        return pd.Series(out)

    return sized.select("a", "b").join(x.select("a", "xa"), "a").join(y.select("b", "xb"), "b").where(near("xa", "xb")).select("a", "b")


def _inside(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside buckets. mixed: bucket, node, size, component. Members are dealt into chunks of bounded number and bytes; a task compares two chunks."""
    lengths = mixed.join(sets.select("node", F.octet_length("elements").alias("bytes")), "node")
    sizes = lengths.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / F.lit(BLOCK_BYTES))).cast("int").alias("chunks"))
    chunks = mixed.join(sizes, "bucket").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    spread = chunks.select("bucket", "node", "component", "chunk", other.alias("other"))
    spread = spread.select("bucket", "node", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        group = group.drop_duplicates("node")
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        own = group["component"].to_numpy()
        home: dict[int, int] = {}

        def root(c: int) -> int:
            while c in home:
                c = home[c]
            return c

        held = [np.frombuffer(x, np.uint64) for x in group["elements"]]
        size = np.array([len(x) for x in held])
        values, code = np.unique(np.concatenate(held), return_inverse=True)
        start = np.cumsum(size) - size
        node, chunk = group["node"].to_numpy(), group["chunk"].to_numpy()
        label, where = np.unique(own, return_inverse=True)
        main = np.bincount(where).argmax()  # members of the largest component needn't be compared with each other
        inside = np.zeros(len(values), bool)
        for p in np.flatnonzero(where != main).tolist():
            current = np.array([root(int(c)) for c in label])[where]
            target = (current != current[p]) & ((chunk != chunk[p]) if i != j else True)
            target &= 100 * np.minimum(size, size[p]) >= percent * np.maximum(size, size[p])
            if not target.any():
                continue
            inside[code[start[p] : start[p] + size[p]]] = True
            common = np.add.reduceat(inside[code], start)
            inside[code[start[p] : start[p] + size[p]]] = False
            for q in np.flatnonzero(target & (100 * common >= percent * (size + size[p] - common))).tolist():
                x, y = root(int(own[p])), root(int(own[q]))
                if x != y:
                    home[max(x, y)] = min(x, y)
                    found.append((int(node[p]), int(node[q])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    parts = max(int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-spread.count() // 2000))
    return spread.join(sets.select("node", "elements"), "node").repartition(parts, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85, rows: int = 8, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Texts whose Jaccard similarity is at least percent / 100 are linked. A null or empty text has an empty set and no link. Rows that
    share a doc_id are one document. A row without id is linked through its equals only. A pair at the threshold is missed with
    a probability of at most `miss`; pairs above are missed less.
    """
    threshold = percent / 100
    docs = documents(docs, id_col, text_col)
    bands = S.bands_for(threshold, rows, miss)
    signed = written(_signed(docs, width, bands, rows), "signed")
    classes = signed.where("n_shingles > 0").groupBy("one", "two").agg(F.min("doc_id").alias("node"))
    members = signed.select("doc_id", "n_shingles", "one", "two").join(classes, ["one", "two"], "left")
    nodes = signed.where("n_shingles > 0 and doc_id is not null").join(classes.where("node is not null"), ["one", "two"]).where("doc_id = node").select("node", "n_shingles", "bands", "sketch")
    entries = written(nodes.select("node", F.explode("bands").alias("bucket")), "entries")
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket", "size")
    mixed = written(entries.join(shared, "bucket"), "buckets")
    forget(entries)
    weight = mixed.groupBy("node").agg(F.sum("size").alias("weight"))
    ranked = mixed.join(weight, "node").select("bucket", "node", F.struct("weight", (-F.col("node")).alias("id")).alias("rank"))
    centres = ranked.groupBy("bucket").agg((-F.max("rank")["id"]).alias("b"))
    pairs = mixed.select("bucket", F.col("node").alias("a")).join(centres, "bucket").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared")).drop("shared")
    sketches = nodes.select("node", "sketch")
    near = _estimate(pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b"), threshold, bands * rows)
    near = written(near.select("a", "b"), "near")
    # Buckets of two are done with their one pair; of larger ones, any member may have to be compared again.
    ids = near.select(F.explode(F.array("a", "b")).alias("node")).unionByName(mixed.where("size > 2").select("node")).distinct()
    ids = written(ids, "ids")
    sets = written(_sets(docs.where("doc_id is not null"), ids, width).dropDuplicates(["node", "elements"]), "sets")
    links = written(_verify(near, sets, percent).distinct(), "verified")
    found = written(components(links), "components")
    large = written(mixed.where("size > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "large")
    apart = large.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    apart = written(apart, "apart")
    more = written(_inside(large.join(apart, "bucket"), sets, percent), "inside")
    if not more.isEmpty():
        found = written(extended(found, more), "components")
    members = written(members, "members")
    forget(signed, mixed, near, ids, sets, links, large, apart, more)  # the result reads the other tables
    out = members.join(found, "node", "left").withColumn("component_id", F.coalesce("component", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 3) - 1], ' ') g FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 3) + 2)) p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
common AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
least_of AS (SELECT a, min(b) c FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, coalesce(c, w.doc_id) component_id, coalesce(c, w.doc_id) = w.doc_id kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON least_of.a = w.doc_id
"""


def clean(docs: DataFrame, width: int = 5, percent: int = 80, **options) -> DataFrame:
    """The rows of docs but one of each component of near duplicates, with all their columns, whatever their names: the first row stays. Null and empty texts stay."""
    key = free(docs, "chronofold_rid")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    stays = near_duplicates(rows.select(key, "text"), id_col=key, width=width, percent=percent, **options).where("kept").select(F.col("doc_id").alias(key))
    return rows.join(stays, key, "left_semi").drop(key)
