"""Token ids of documents in files of blocks that are compressed by a Re-Pair grammar.

A block holds the ids of whole documents in ascending doc_id order. Frequent pairs of neighbours are replaced by new symbols, round
after round; the rules are stored with the length of what each symbol stands for. No pair takes in an end id, so every document
starts at a symbol of its own and any stretch of it can be decoded alone.

Block, little-endian: b"RPB1", counts of documents, rules and symbols, first nonterminal and end id (unsigned 32 bits each); for each document its
doc_id (signed 64), whether it has one (8), number of ids (unsigned 64) and of symbols (unsigned 32); for each rule its two symbols, then for each its
expansion length (unsigned 32); the symbols; crc32 of all that comes before. A symbol has 2, 3 or 4 bytes, as few as all rules need.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import documents, map_arrow, small_batches, spark_schema, work_path
from chronofold.llm.encode import crc, encoder, vocabulary_size, word_tokenizer
from chronofold.llm.textvec import ragged

#: Ids of a block; a longer document has a block of its own.
BLOCK_IDS = 1 << 20
#: Slots (2 to this at most, one for each pair or more below) by which rare pairs are told before pairs are counted.
SLOT_BITS = 20
#: Words that a worker keeps with their ids, in some 170 MB.
WORDS = 2_000_000
#: A level ends with a round that replaces less than one of so many symbols.
FEW = 16
HEAD = struct.Struct("<4s5I")
FILE = "shard int, block int, low long, high long, payload binary"


def _slots(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each pair, and how often each slot is hit: no pair occurs more often than its slot is hit."""
    bits = min(SLOT_BITS, max(8, len(left).bit_length()))
    slot = ((left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)).astype(np.intp)
    return slot, np.bincount(slot, minlength=1 << bits)


def frequent_pairs(seq: np.ndarray, places: np.ndarray | None, end_id: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, both symbols as one number) of every pair that occurs `least` times or more at the places (all, if None), and of some that don't. None takes in an end id."""
    left, right = seq[:-1], seq[1:]
    if places is not None:
        left, right = left[places], right[places]
    # A slot of a hash that is hit less often than `least` holds no such pair; only what is left has to be sorted.
    slot, hits = _slots(left, right)
    some = np.flatnonzero((hits >= least).take(slot))
    a, b = left[some], right[some]
    inner = (a != end_id) & (b != end_id)
    some = some[inner]
    return some if places is None else places[some], a[inner].astype(np.uint64) << np.uint64(32) | b[inner]


def _alternate(at: np.ndarray) -> np.ndarray:
    """Of pairs that overlap in a row every other one, from the left, as a mask."""
    begin = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return (np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0


def compress(ids: np.ndarray, first: int, end_id: int, least: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, expansion lengths), where no pair occurs `least` times any more; a rule that is used less often costs more than it saves.

    Rules are made in rounds, the most frequent pairs first: those that occur as often as a level says, which falls to `least` by eighths. All pairs of a round are
    replaced at once, from left to right. A round after another on the same level looks only at places next to new symbols and at those of
    frequent pairs that weren't replaced: no other pair has become more frequent. When the level falls, all places are counted.
    """
    seq = ids.astype(np.uint32)  # a copy
    rules, lengths, top = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.int64), first
    level, places = max(least, int(_slots(seq[:-1], seq[1:])[1].max()) // 8), None
    while len(seq) > 1:
        at, key = frequent_pairs(seq, places, end_id, level)
        pair, back, count = np.unique(key, return_inverse=True, return_counts=True)
        good = count >= level
        symbol = np.where(good, np.cumsum(good) - 1, -1)[back]
        at, symbol = at[symbol >= 0], symbol[symbol >= 0]
        waiting, free = at, _alternate(at)
        at, symbol = at[free], symbol[free]
        used = np.bincount(symbol, minlength=int(good.sum()))
        keep = used >= least  # pairs that lose too many places to their neighbours wait
        if not keep.any():
            if level > least:
                level, places = max(least, level // 8), None
                continue
            if not good.any():
                break
            keep = used == used.max()
        chosen = keep[symbol]
        at, symbol = at[chosen], (np.cumsum(keep) - 1)[symbol[chosen]]
        made = pair[good][keep]
        made = np.column_stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)]).astype(np.uint32)
        seq[at] = (top + symbol).astype(np.uint32)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        lengths = np.concatenate([lengths, sizes(made[:, 0], lengths, first) + sizes(made[:, 1], lengths, first)])
        rules.append(made)
        if level > least and len(at) < len(seq) // FEW:  # what is left on this level is found on the next
            level, places = max(least, level // 8), None
        else:
            stay[at] = False
            waiting = waiting[stay[waiting] & stay[waiting + 1]]
            new = at - np.arange(len(at))
            look = np.zeros(len(seq) + 1, bool)  # the pair before each symbol
            look[new] = look[new + 1] = look[waiting - np.searchsorted(at, waiting) + 1] = True
            places = np.flatnonzero(look[1:-1])
        top += len(made)
    return seq, np.concatenate(rules), lengths


def sizes(symbols: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    out = np.ones(len(symbols), np.int64)
    rule = symbols >= first
    out[rule] = lengths[symbols[rule].astype(np.int64) - first]
    return out


def expand_part(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of what symbols stand for. Rules are opened one level after the other, and symbols outside the stretch fall away, so that only rules that hold some of it are read."""
    while True:
        end = np.cumsum(sizes(symbols, lengths, first))
        i, j = np.searchsorted(end, start, "right"), np.searchsorted(end, stop) + 1
        before = int(end[i - 1]) if i else 0
        symbols, start, stop = symbols[i:j], start - before, stop - before
        rule = symbols >= first
        if not rule.any():
            return symbols[start:stop]
        out = np.repeat(symbols, np.where(rule, 2, 1))
        place = np.cumsum(np.where(rule, 2, 1))[rule]
        pair = rules[symbols[rule].astype(np.int64) - first]
        out[place - 2], out[place - 1] = pair[:, 0], pair[:, 1]
        symbols = out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    begin = np.cumsum(lengths) - lengths
    whole = np.zeros(int(lengths.sum()), np.uint32)
    for i, (pair, at) in enumerate(zip(rules.tolist(), begin.tolist())):
        for s in pair:
            if s < first:
                whole[at] = s
                at += 1
            else:
                n = int(lengths[s - first])
                whole[at : at + n] = whole[begin[s - first] : begin[s - first] + n]
                at += n
    rule, size = symbols >= first, sizes(symbols, lengths, first)
    # Terminals are looked up behind the expansions.
    offset = np.where(rule, begin[np.where(rule, symbols.astype(np.int64) - first, 0)] if len(begin) else 0, 0)
    offset[~rule] = len(whole) + np.arange(int((~rule).sum()))
    return np.concatenate([whole, symbols[~rule].astype(np.uint32)])[ragged(offset, size)]


def _width(symbols: int) -> int:
    """Bytes of a symbol where there are so many."""
    return 2 if symbols <= 1 << 16 else 3 if symbols <= 1 << 24 else 4


def _as_bytes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _from_bytes(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view("<u4").ravel()


def pack_block(doc_ids: list[int | None], texts: list[np.ndarray], first: int, end_id: int) -> bytes:
    ids = np.concatenate(texts)
    if int(ids.max()) >= first:
        raise ValueError(f"id {int(ids.max())} is taken for a rule: first must be above all ids")
    symbols, rules, lengths = compress(ids, first, end_id)
    at = np.cumsum(sizes(symbols, lengths, first))
    last = np.searchsorted(at, np.cumsum([len(t) for t in texts])) + 1
    width = _width(first + len(rules))
    body = b"".join([
        HEAD.pack(b"RPB1", len(texts), len(rules), len(symbols), first, end_id),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array([len(t) for t in texts], "<u8").tobytes(), np.diff(last, prepend=0).astype("<u4").tobytes(),
        _as_bytes(rules.ravel(), width), lengths.astype("<u4").tobytes(), _as_bytes(symbols, width),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass(frozen=True)
class Block:
    doc_ids: list[int | None]
    counts: np.ndarray
    symbol_counts: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    first: int

    @classmethod
    def read(cls, data: bytes) -> Block:
        magic, docs, rules, symbols, first, _ = HEAD.unpack_from(data)
        if magic != b"RPB1" or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole block")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, has = take("<i8", docs), take("u1", docs)
        counts, held = take("<u8", docs).astype(np.int64), take("<u4", docs).astype(np.int64)
        width = _width(first + rules)
        pairs, lengths = _from_bytes(take("u1", 2 * rules * width), width).reshape(-1, 2), take("<u4", rules).astype(np.int64)
        return cls([i if h else None for i, h in zip(ids.tolist(), has.tolist())], counts, held, pairs, lengths, _from_bytes(take("u1", symbols * width), width), first)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        ids = expand(self.symbols, self.rules, self.lengths, self.first)
        stop = np.cumsum(self.counts)
        for d, a, b in zip(self.doc_ids, (stop - self.counts).tolist(), stop.tolist()):
            yield d, ids[a:b]

    def tokens(self, document: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of one document (by its number in the block); of the rules only those that hold some of them are opened."""
        a = int(self.symbol_counts[:document].sum())
        n = int(self.counts[document])
        start, stop = min(max(start, 0), n), min(max(stop, 0), n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        return expand_part(self.symbols[a : a + int(self.symbol_counts[document])], self.rules, self.lengths, self.first, start, stop)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tokenizer: str | None = None, first: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Write all documents (null text: empty) to a folder of shard files, one for each range of doc_id; nulls come first, equal ids by a hash of the text.

    first: the symbol of the first rule; by default the first number that is neither an id of the tokenizer nor end_id. The blocks of a shard are rows of
    Parquet files, which any store of Spark's can hold, with the least and greatest doc_id of each, by which fetch() finds a document. Long texts are
    encoded whole; repeated rows are documents of their own; an empty table gives no block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = spark_schema(spark, FILE)
    vocabulary = tokenizer or word_tokenizer()
    first = max(vocabulary_size(vocabulary), end_id + 1) if first is None else first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary, WORDS)
        shard, block, total = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            known = [d for d in names if d is not None]
            row = (shard, block, min(known, default=None), max(known, default=None), pack_block(names, held, first, end_id))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kinds)], schema=kinds)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, ids in words.documents(batch.column("text"), end_id):
                if held and total + len(ids) > block_ids:
                    yield done()
                    block, total, names, held = block + 1, 0, [], []
                names.append(doc_ids[i])
                held.append(ids)
                total += len(ids)
        if held:
            yield done()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]  # an id that many rows share, or none, is dealt to several shards
    ordered = documents(docs, id_col, text_col).withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").drop("tie")
    ordered.mapInArrow(run, FILE).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files of write()."""

    def make():
        def each(batch: pa.RecordBatch):
            for shard, block, payload in zip(*(batch.column(n).to_pylist() for n in ("shard", "block", "payload"))):
                found = [(d, len(ids), crc(ids)) for d, ids in Block.read(payload).documents()]
                n = np.array([x[1] for x in found], np.int64)
                yield {"shard": [shard] * len(n), "block": [block] * len(n), "doc_id": [x[0] for x in found], "inside": np.cumsum(n) - n, "n_tokens": n, "ids_crc32": [x[2] for x in found]}

        return each

    files = spark.read.schema(FILE).parquet(path)
    rows = map_arrow(files, make, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows


def fetch(spark: SparkSession, path: str, doc_id: int, start: int = 0, stop: int = 1 << 62) -> list[np.ndarray]:
    """Ids start to stop of the documents of an id, by the blocks whose range holds it; Parquet's statistics leave out the others."""
    blocks = spark.read.schema(FILE).parquet(path).where((F.col("low") <= doc_id) & (F.col("high") >= doc_id)).orderBy("shard", "block").select("payload")
    out = []
    for row in blocks.toLocalIterator():
        block = Block.read(row["payload"])
        out += [block.tokens(i, start, stop) for i, d in enumerate(block.doc_ids) if d == doc_id]
    return out


def encode(docs: DataFrame, **options) -> DataFrame:
    """Write the ids of all documents and read them back."""
    spark = docs.sparkSession
    path = work_path(spark, "tokens")
    write(docs, path, **options)
    decoded = work_path(spark, "decoded")
    read(spark, path).write.parquet(decoded)
    rows = spark.read.parquet(decoded)
    # Sums of blocks, then of shards: each prefix sum runs over one row for each block of a shard, or one for each shard.
    blocks = rows.groupBy("shard", "block").agg(F.sum("n_tokens").alias("n"))
    before = blocks.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("in_shard"))
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    out = rows.join(before.join(shards, "shard"), ["shard", "block"])
    return out.select("doc_id", (F.col("before") + F.col("in_shard") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
