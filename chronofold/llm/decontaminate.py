"""Benchmark decontamination by a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import textvec as V
from chronofold.llm.common import col, documents, free, map_arrow, written

#: Words of test items that one automaton may have (some 400 MB of a Python worker); more items make more automata, each with a pass of its own over the documents.
MOST_WORDS = 500_000
FOUND = "rid long, doc_id long, n_words long, spans array<int>, items array<long>"


class Automaton:
    """All substrings of the items' word sequences; a state knows the items' windows that end there."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int):
        self.words = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, np.searchsorted(self.words, w).tolist()) for i, w in items]
        for _, code in coded:
            last = 0
            for c in code:
                last = self._extend(last, c)
        own: dict[int, dict[int, set[int]]] = {}
        self.shortest = min((min(len(c), window) for _, c in coded), default=0)
        pairs = set()
        for item, code in coded:
            pairs.update(zip(code, code[1:]))
            size = min(len(code), window)
            for a in range(len(code) - size + 1):
                state = 0
                for c in code[a : a + size]:
                    state = self.next[state][c]
                own.setdefault(state, {}).setdefault(size, set()).add(item)
        self.pairs = np.array(sorted(a * len(self.words) + b for a, b in pairs), np.int64)
        # What ends at a state also ends at the states below it in the tree of suffix links; longer states come later.
        self.marks: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in self.next]
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            above = self.marks[self.link[state]] if state else []
            self.marks[state] = above + [(n, tuple(i)) for n, i in own.get(state, {}).items()] if state in own else above

    def _extend(self, last: int, c: int) -> int:
        following = self.next[last].get(c)
        if following is not None and self.length[following] == self.length[last] + 1:
            return following
        if following is not None:
            return self._clone(last, c, following)
        state = self._new(self.length[last] + 1, {})
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = state
            last = self.link[last]
        if last < 0:
            self.link[state] = 0
        elif self.length[q := self.next[last][c]] == self.length[last] + 1:
            self.link[state] = q
        else:
            self.link[state] = self._clone(last, c, q)
        return state

    def _new(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, last: int, c: int, q: int) -> int:
        copy = self._new(self.length[last] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while last >= 0 and self.next[last].get(c) == q:
            self.next[last][c] = copy
            last = self.link[last]
        return copy

    def candidates(self, word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of each word, starts, ends) of the runs that can hold a window: item words of one text, each pair of neighbours one of an item."""
        code = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        known = self.words[code] == word
        pair = code[:-1] * len(self.words) + code[1:]
        joined = known[:-1] & known[1:] & (row[1:] == row[:-1])
        at = np.flatnonzero(joined)
        if len(self.pairs):
            place = np.minimum(np.searchsorted(self.pairs, pair[at]), len(self.pairs) - 1)
            joined[at] = self.pairs[place] == pair[at]
        else:
            joined[:] = False
        first = known.copy()
        first[1:] &= ~joined
        last = known.copy()
        last[:-1] &= ~joined
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        enough = end - start >= self.shortest
        return code, start[enough], end[enough]

    def stream(self, code: list[int]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, end, items) of each window that occurs, from the longest match that ends at each word."""
        state = size = 0
        for i, c in enumerate(code, 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            following = self.next[state].get(c)
            if following is None:
                size = 0
                continue
            state = following
            size += 1
            for n, items in self.marks[state]:
                if n <= size:
                    yield i - n, i, items


@dataclass(frozen=True, eq=False)
class Items:
    """Words of test items, as tasks get them."""

    items: list[tuple[int, np.ndarray]]
    window: int


@lru_cache(1)
def automaton_of(items: Items) -> Automaton:
    """One automaton for all tasks of a Python worker that get the same items."""
    return Automaton(items.items, items.window)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, most_words: int = MOST_WORDS) -> DataFrame:
    """rid, doc_id, n_words, spans (start and end of each run of hit words, in turn), items (whose windows occur) of every document.

    Nulls and empty texts have no words; items without words or id have no windows; an item with fewer words than the window
    is one window. Repeated items and documents count each. rid tells rows of the same doc_id apart.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    tests = documents(benchmark, item_col, item_text_col).where("doc_id is not null")

    def coded():
        def each(batch: pa.RecordBatch):
            out = [[] for _ in range(batch.num_rows)]
            for row, word in V.words(batch.column("text"), V.NOT_ALNUM):
                for i, w in zip(row.tolist(), word.view(np.int64).tolist()):
                    out[i].append(w)
            yield {"item": batch.column("doc_id"), "n": [len(x) for x in out], "words": pa.array(out, pa.list_(pa.int64()))}

        return each

    items = map_arrow(tests, coded, "item long, n int, words array<long>").where("n > 0")
    total = items.agg(F.sum("n")).first()[0] or 0
    if total > most_words:  # shards of bounded size, cut by the running number of words
        rows, items = written(rows, "documents"), written(items, "items")
        shards = int(total // most_words + 1) * 2
        sets = (items.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k).toPandas() for k in range(shards))
    else:
        sets = iter([items.toPandas()])
    found = [_one_pass(rows, [(i, np.array(w, np.int64).view(np.uint64)) for i, w in zip(s["item"].tolist(), s["words"])], window) for s in sets]
    if len(found) == 1:
        return found[0]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return _united(out)


def _one_pass(rows: DataFrame, items: list[tuple[int, np.ndarray]], window: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Items(items, window))

    def make():
        automaton = automaton_of(shared.value)

        def each(batch: pa.RecordBatch):
            n = np.zeros(batch.num_rows, np.int64)
            hits: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[int]] = {}
            for row, word in V.words(batch.column("text"), V.NOT_ALNUM):
                if not len(row):
                    continue
                n += np.bincount(row, minlength=len(n))
                if not automaton.shortest:
                    continue
                code, start, end = automaton.candidates(word, row)
                for a, b in zip(start.tolist(), end.tolist()):
                    i = int(row[a])
                    base = a - int(np.searchsorted(row, i))
                    for s, e, of in automaton.stream(code[a:b].tolist()):
                        hits.setdefault(i, []).append((base + s, base + e))
                        items.setdefault(i, set()).update(of)
            yield {
                "rid": batch.column("rid"), "doc_id": batch.column("doc_id"), "n_words": n,
                "spans": pa.array([merged(hits.get(i, ())) for i in range(len(n))], pa.list_(pa.int32())),
                "items": pa.array([sorted(items.get(i, ())) for i in range(len(n))], pa.list_(pa.int64())),
            }

        return each

    return map_arrow(rows, make, FOUND)


def merged(spans) -> list[int]:
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _united(found: DataFrame) -> DataFrame:
    whole = F.pandas_udf(lambda lists: lists.map(lambda x: merged([(int(s[i]), int(s[i + 1])) for s in x for i in range(0, len(s), 2)])), "array<int>")
    both = found.groupBy("rid", "doc_id", "n_words").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return both.select("rid", "doc_id", "n_words", whole("spans").alias("spans"), "items")


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """The digest of find(): contaminated if hit words are at least one in `share`."""
    hit = F.expr("aggregate(sequence(0, greatest(size(spans) - 2, 0), 2), 0L, (a, i) -> a + coalesce(get(spans, i + 1) - get(spans, i), 0))")
    sha = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",").cast("binary"), 256)
    out = found.select("rid", "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns, whatever their names; rows without text or id stay."""
    key = free(docs, "chronofold_rid")
    docs = written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    gone = judged(find(docs.select(col(key), col("text")), benchmark, id_col=key, window=window), share).where("contaminated").select(F.col("doc_id").alias(key))
    return docs.join(gone, key, "left_anti").drop(key)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return judged(find(docs, items)).drop("rid")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') win
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.p, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT pos) n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) pos FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(l, '')) items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
