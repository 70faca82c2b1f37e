"""Duplicate lines by a segment-partition edit join.

Two lines are near if they are within as many edits as the shorter one allows: one for each `per` characters, rounded, and at most `edits`. Where that
rounds to none (under half of `per`), lines are near if they are equal. Lengths are dealt into classes of lines that allow as many edits. In a class of k edits a
line has k + 1 segments of one size: the first half of them measured from its start, the others from its end, and what is over lies between them.

Take two near lines, and the first segment i (from 0) of the shorter such that at most i edits lie in or before it: exactly i lie before it, none in it and at most k - i
behind it. So it stands unchanged in the longer line, at most i places away from its place from the start, and at most k - i from that
from the end: min(i, k - i) places from where it is measured. A segment's key is the least hash of the q-grams in it, q being three quarters of its size. The longer
line has the key of every such place, and neighbouring places mostly share one, so a line has about two keys for each segment instead of
one for each place, and no near pair is without a common key. Pairs are verified by an edit distance over the band of k cells beside the diagonal.

A bucket isn't spread into all its pairs: members are compared with one centre, the least of them, first, and then, where a bucket still has several classes,
with each other in blocks. Both times lengths and tallies of characters (64 bytes a line) come first, and lines are fetched only where these leave a pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import textvec as V
from chronofold.llm.common import as_arrow, col, drop_stores, forget, free, map_arrow, release, small_batches, spark_schema, tidy, written
from chronofold.llm.components import components, extended

_U = np.uint64
#: Members of a bucket that a task compares with as many others, and their bytes.
BLOCK = 1000
BLOCK_BYTES = 16 << 20
#: Ids that may be broadcast (8 MB); more are joined by a shuffle.
MOST_IDS = 1_000_000
#: Edits that two lines may be apart: one for each PER characters of the shorter one, at most EDITS.
EDITS, PER = 8, 20
#: Bits of the map of lines in shared buckets that executors get (8 MB); with more lines it lets more pass, which joins leave out.
MAP_BITS = 26
#: Lines of a bucket that one row holds.
PART = 4096
#: Lines that a task remembers to have handed on.
MOST_SEEN = 1 << 17
#: Bits of a bucket's key, of which those over 32 are its slice (half a million keys of 30 GB). Buckets that agree in them are one, which costs comparisons but no link.
KEY_BITS = 44
#: Keys that a task holds before it hands them on.
MOST_HELD = 1 << 20
#: A character that makes a line one that isn't blank.
INK = r"[^\x00-\x20\xA0]"
BLANK = re.compile(r"[\x00-\x20\xA0]*")


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger: bit-parallel columns of the band of `most` cells on each side of the diagonal."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    # Column c holds the rows c - most to c + most as one word of vertical differences; the word moves down a row with each column, so
    # its lowest bit leaves and a new highest one comes in. `where` has the rows of each character, as of the column it was last seen in.
    width = 2 * most + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    plus, minus = mask ^ ((1 << most) - 1), 0
    where: dict[str, tuple[int, int]] = {}

    def seen(c: str, row: int, column: int) -> None:
        bits, since = where.get(c, (0, column))
        where[c] = (bits >> (column - since) | 1 << (row - column + most), column)

    for row in range(min(most, len(a))):
        seen(a[row], row, 0)
    score = min(most, len(a))  # of the cell in the band's last row
    for column, c in enumerate(b):
        if column + most < len(a):
            seen(a[column + most], column + most, column)
        bits, since = where.get(c, (0, column))
        equal = bits >> (column - since)
        diagonal = ((((equal & plus) + plus) ^ plus) | equal | minus) & mask
        rise, fall = minus | ~(diagonal | plus) & mask, diagonal & plus
        if column + most < len(a):
            score += not diagonal & top
            if score > 2 * most + len(b) - len(a):
                return most + 1
        else:  # the last row of the matrix is in the band, one bit lower with each column
            last = 1 << (len(a) - 1 - column + most)
            score += bool(rise & last) - bool(fall & last)
            if score - (len(b) - column - 1) > most:
                return most + 1
        down = diagonal >> 1
        plus, minus = (fall | ~(down | rise)) & mask, down & rise
    return min(score, most + 1)


def allowed(length: int, edits: int, per: int | None) -> int:
    """Edits that a line of such a length may be apart from one as long or longer; without `per` the same for all lengths."""
    return edits if per is None else min(edits, (length + per // 2) // per)


def length_classes(longest: int, edits: int, per: int | None) -> list[tuple[int, int, int]]:
    """(least length, edits, size of a segment) of each class up to a length; all lengths of a class allow as many edits, one at least."""
    out, low = [], edits + 1 if per is None else max(per - per // 2, 2)
    while edits and low <= longest:
        own = allowed(low, edits, per)
        out.append((low, own, low // (own + 1)))
        up = low + max(low // 5, 2 * edits, 20)
        if per is not None and own < edits:
            up = min(up, (own + 1) * per - per // 2)
        low = up
    return out


def _chunks(texts: pa.Array, least: int, size: int = V.CHUNK) -> Iterator[list[str]]:
    """The distinct lines of texts that aren't blank and have `least` characters, in groups of about a size; a longer line is a group with others."""
    held, total = set(), 0
    for text in texts.to_pylist():
        text, at = text or "", 0
        while at <= len(text):
            cut = text.find("\n", at + size) if len(text) - at > size else -1
            for line in text[at : cut if cut >= 0 else len(text)].split("\n"):
                if len(line) >= least and line not in held:
                    held.add(line)
                    total += len(line) + 1
            if total >= size:
                yield list(held)
                held, total = set(), 0
            at = cut + 1 if cut >= 0 else len(text) + 1
    if held:
        yield list(held)


def _least_of(value: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` values from each place on."""
    have = 1
    while have < width:
        step = min(have, width - have)
        value = np.minimum(value[:-step], value[step:])
        have += step
    return value


def line_entries(texts: pa.Array, edits: int = EDITS, per: int | None = PER, keys: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """For groups of lines: (64-bit hash of each distinct line, line and bucket key of its entries, the lines). Lines that allow no edit aren't among them."""
    least = min((c[0] for c in length_classes(1 << 20, edits, per)), default=1 << 62)
    for lines in _chunks(texts, least):
        lines = sorted((x for x in lines if BLANK.fullmatch(x) is None), key=len)  # so that a length class is one stretch of the characters
        if not lines:
            continue
        data = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, lines), np.int64, len(lines))
        start = np.cumsum(length + 1) - length - 1
        up, down = V.powers(len(data) + 1)
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(data * up[: len(data)], out=total[1:])
        name = V.mix((total[start + length] - total[start]) * down[start] + V.mix(length.astype(_U)))
        owner, found = [], []
        classes = length_classes(int(length[-1]), edits, per) if keys else []
        for (low, own, size), high in zip(classes, [*(c[0] for c in classes[1:]), 1 << 40]):
            # Lines of the class, and longer ones that are near enough to one of them.
            a, b = np.searchsorted(length, [low, high + own])
            if a == b:
                continue
            q = max(1, size * 3 // 4)
            s, e = int(start[a]), int(start[b - 1] + length[b - 1])
            # Hashes of the q-grams from each place on, and the least hash of those in a segment from there.
            least_hash = _least_of((total[s + q : e + 1] - total[s : e + 1 - q]) * down[s : e + 1 - q], size - q + 1)
            place, who = start[a:b] - s, np.arange(a, b)
            for i in range(own + 1):
                shift = min(i, own - i)
                begin = place + (i * size if i <= own - i else length[a:b] - (own + 1 - i) * size)
                value = least_hash[begin] if not shift else least_hash[begin[:, None] + np.arange(-shift, shift + 1)]
                if shift:
                    value.sort(axis=1)
                    new = np.ones(value.shape, bool)
                    np.not_equal(value[:, 1:], value[:, :-1], out=new[:, 1:])
                    owner.append(np.repeat(who, new.sum(axis=1)))
                    value = value[new]
                else:
                    owner.append(who)
                salt = ((low << 8) + i + 1) * 0x9E3779B97F4A7C15 % 2**64
                found.append((value ^ _U(salt)) * _U(0xD6E8FEB86659FD93))  # the least of many hashes has few high bits
        who = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        key = np.concatenate(found) if found else np.zeros(0, _U)
        yield name.view(np.int64), who, (key & ~_U((1 << 64 - KEY_BITS) - 1)).view(np.int64), lines


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.view(_U) >> _U(64 - MAP_BITS)).astype(np.int64)


def _map_of(nodes: DataFrame) -> np.ndarray:
    """Which of 2^MAP_BITS slots a node falls in, as bits; at most 2^(MAP_BITS - 6) words come to the driver."""
    word = F.shiftrightunsigned("node", 64 - MAP_BITS + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(node, {64 - MAP_BITS}) & 63 as int))")
    found = nodes.select(word.cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << MAP_BITS - 6, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _entries(rows: DataFrame, edits: int, per: int | None) -> DataFrame:
    """slice, keys, nodes of every line's keys: sorted keys without the bits that are their slice (4 bytes each), and the hashes of their lines (8 bytes each)."""
    schema = "slice int, keys binary, nodes binary"
    kinds = spark_schema(rows.sparkSession, schema)
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        drop_stores()
        tidy()
        for batch in batches:
            for name, who, key, _ in line_entries(batch.column("text"), edits, per):
                held.append((key, name[who]))
                total += len(key)
                if total >= MOST_HELD:
                    yield sliced(held)
                    held, total = [], 0
        if total:
            yield sliced(held)
        held = []
        tidy()

    def sliced(held) -> pa.RecordBatch:
        key, node = map(np.concatenate, zip(*held))
        key = key.view(_U) >> _U(64 - KEY_BITS)
        order = np.argsort(key)
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        edge = np.searchsorted(key, np.arange((1 << KEY_BITS - 32) + 1, dtype=_U) << _U(32))
        some = np.flatnonzero(np.diff(edge))
        edge = np.append(edge[some], len(key))
        binary = [pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((edge * v.itemsize).astype(np.int32)), pa.py_buffer(v)]) for v in (key.astype("<u4"), node)]
        return pa.RecordBatch.from_arrays([as_arrow(some, pa.int32()), *binary], schema=kinds)

    return rows.select("text").mapInArrow(run, schema)


def _shared(entries: DataFrame, members: bool = False) -> DataFrame:
    """bucket, low (least node) of all buckets that several lines are in.

    With members also one and two, which are equal for buckets of the same lines, size, and their nodes in order, PART in a row, and the row's number.
    """
    schema = "bucket long, low long" + ", one long, two long, size long, part long, nodes array<long>" * members
    kinds = spark_schema(entries.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A slice may go on from one batch to the next: the last one of a batch waits.
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            slices = batch.column("slice").to_numpy()
            keys, nodes = batch.column("keys"), batch.column("nodes")
            many = pc.binary_length(keys).to_numpy() // 4
            key = np.repeat(slices.astype(_U) << _U(32), many) | np.frombuffer(b"".join(keys.to_pylist()), "<u4")
            node = np.frombuffer(b"".join(nodes.to_pylist()), np.int64)
            cut = int(many[slices != slices[-1]].sum()) if len(slices) else 0
            if len(slices) and held and held[-1][0][0] >> _U(32) != slices[0]:
                yield found(held)
                held = []
            if cut:
                yield found([*held, (key[:cut], node[:cut])])
                held = []
            if len(slices):
                held.append((key[cut:], node[cut:]))
        if held:
            yield found(held)
        held = []
        tidy()

    def found(held) -> pa.RecordBatch:
        key, node = map(np.concatenate, zip(*held))
        order = np.argsort(key)
        key, node = key[order], node[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        low, high = np.minimum.reduceat(node, start), np.maximum.reduceat(node, start)
        some = low < high
        bucket, low = (key[start[some]] << _U(64 - KEY_BITS)).view(np.int64), low[some]
        if not members:
            return pa.RecordBatch.from_arrays([as_arrow(c, pa.int64()) for c in (bucket, low)], schema=kinds)
        member = np.repeat(some, np.diff(np.append(start, len(key))))
        key, node = key[member], node[member]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])  # a line may come from several tasks
        key, node = key[new], node[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        size = np.diff(np.append(start, len(key)))
        sums = [np.add.reduceat(V.mix(node.view(_U) ^ _U(salt)), start).view(np.int64) for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
        rows = -(-size // PART)
        part = V.ragged(np.zeros(len(rows), np.int64), rows)
        edge = np.append(np.repeat(start, rows) + part * PART, len(node)).astype(np.int32)
        columns = [as_arrow(c, pa.int64()) for c in (*(np.repeat(c, rows) for c in (bucket, low, *sums, size)), part)]
        return pa.RecordBatch.from_arrays([*columns, as_arrow(pa.ListArray.from_arrays(pa.array(edge), pa.array(node)), kinds.field("nodes").type)], schema=kinds)

    return entries.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, schema)


def _sets(entries: DataFrame) -> DataFrame:
    """bucket, low, size, part, nodes as _shared, of the least of the buckets that the same lines are in: near lines mostly share several keys, of which one does.

    Sets are told apart by two sums of 64-bit hashes of their members, and the least of these. Rows of the same number have the same nodes.
    """
    same = _shared(entries, True).groupBy("low", "one", "two", "size", "part")
    return same.agg(F.min("bucket").alias("bucket"), F.first("nodes").alias("nodes")).select("bucket", "low", "size", "part", "nodes")


def _sharing(rows: DataFrame, edits: int, per: int | None, slots) -> DataFrame:
    """node, line_id, line, size, bytes, tally of the lines that the map of nodes has, at least once for each task."""

    def make():
        seen: set[bytes] = set()

        def each(batch: pa.RecordBatch):
            wanted = slots.value
            for name, _, _, lines in line_entries(batch.column("text"), edits, per, keys=False):
                slot = _slot(name)
                some = np.flatnonzero(wanted[slot >> 6] >> (slot & 63).astype(_U) & _U(1))
                data = [lines[i].encode() for i in some.tolist()]
                ids = [hashlib.md5(x, usedforsecurity=False).digest() for x in data]
                new = [k for k, x in enumerate(ids) if x not in seen]
                if len(seen) > MOST_SEEN:
                    seen.clear()
                seen.update(ids)
                some, data, ids = some[new], [data[k] for k in new], [ids[k] for k in new]
                held = [lines[i] for i in some.tolist()]
                counts = np.minimum(tallies(held), 255).astype(np.uint8)  # what is cut off only makes lines look more alike
                sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (held, data)]
                yield {"node": name[some], "line_id": ids, "line": held, "size": sizes[0], "bytes": sizes[1], "tally": [c.tobytes() for c in counts]}

        return each

    return map_arrow(rows.select("text"), make, "node long, line_id binary, line string, size long, bytes long, tally binary")


def _members(rows: DataFrame, edits: int, per: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bucket, node, low, size of all buckets that several lines are in, one for each set of lines, low being the least of them; node, line_id, size, bytes, tally of these lines; a table that _fetched reads).

    Two lines of one hash are two rows of one node, and its pairs are verified for both. The last two may have lines that no bucket has.
    """
    spark = rows.sparkSession
    sets = written(_sets(_entries(rows, edits, per)), "members")
    release(spark)
    members = sets.select("bucket", F.explode("nodes").alias("node"), "low", "size")
    members.chronofold_path = sets.chronofold_path
    slots = spark.sparkContext.broadcast(_map_of(members))  # 8 MB
    sharing = written(_sharing(rows, edits, per, slots), "sharing", "zstd")
    sketches = written(sharing.select("node", "line_id", "size", "bytes", "tally").dropDuplicates(["node", "line_id"]), "sketches")
    release(spark)
    return members, sketches, sharing


def _fetched(sharing: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, line of the lines of some nodes, each once."""
    ids = written(nodes.distinct(), "ids")
    few = ids.count() <= MOST_IDS
    wanted = sharing.select("node", "line_id", "line").join(F.broadcast(ids) if few else ids, "node", "left_semi")
    out = written(wanted.dropDuplicates(["node", "line_id"]).select("node", "line"), "fetched")
    forget(ids)
    release(sharing.sparkSession)
    return out


def tallies(lines: list[str]) -> np.ndarray:
    """How often each line has characters of 64 kinds. An edit changes two counts by one at most, so near lines differ by twice their edits in all at most."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) & 63
    return np.bincount(np.repeat(np.arange(len(lines)) << 6, size) + code, minlength=len(lines) << 6).reshape(-1, 64).astype(np.int32)


def _unlike(xs: list[str], ys: list[str]) -> np.ndarray:
    """How much tallies of halves of two lines differ in all, by twice their edits at most.

    The shorter line's first half is held against as many characters at the start of the longer one, and its rest against as many at the end. An edit before the
    middle of the shorter line counts for the first ones only, by two: a character that is put in or taken out moves one over their end.
    """
    pairs = [(x, y, len(x) // 2) if len(x) <= len(y) else (y, x, len(y) // 2) for x, y in zip(xs, ys)]
    start = np.abs(tallies([x[:h] for x, _, h in pairs]) - tallies([y[:h] for _, y, h in pairs])).sum(axis=1)
    return start + np.abs(tallies([x[h:] for x, _, h in pairs]) - tallies([y[len(y) - len(x) + h :] for x, y, h in pairs])).sum(axis=1)


def near_lines(xs: list[str], ys: list[str], edits: int, per: int | None) -> np.ndarray:
    """Whether each pair of lines is near: the columns of edit_distance for many pairs at once, short lines of like length together."""
    n, m = np.array([len(x) for x in xs], np.int64), np.array([len(y) for y in ys], np.int64)
    limit = np.array([allowed(v, edits, per) for v in np.minimum(n, m).tolist()], np.int64)
    out = np.array([x == y for x, y in zip(xs, ys)], bool)
    todo = np.flatnonzero(~out & (np.abs(n - m) <= limit))
    if len(todo):
        todo = todo[_unlike([xs[i] for i in todo], [ys[i] for i in todo]) <= 2 * limit[todo]]
    todo = todo[np.argsort(m[todo], kind="stable")]
    at = 0
    while at < len(todo):
        width = int(m[todo[at]]) + 64
        stop = min(at + max(1, (1 << 20) // width), int(np.searchsorted(m[todo], width, "right")))
        some, at = todo[at:stop], stop
        if width > 4096 or len(some) < 12 or edits > 25:
            out[some] = [edit_distance(xs[i], ys[i], k) <= k for i, k in zip(some.tolist(), limit[some].tolist())]
        else:
            out[some[_banded([xs[i] for i in some], [ys[i] for i in some], n[some], m[some], limit[some])]] = True
    return out


def _banded(xs: list[str], ys: list[str], n: np.ndarray, m: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Numbers of the pairs within their limits; no limit is over 25."""
    most = int(limit.max())
    mask, top = _U((1 << 2 * most + 1) - 1), _U(2 * most)
    wide = 32 if 2 * most < 32 else 64  # cells that are compared at once, of which the band's are used
    code = [np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) for texts in (xs, ys)]
    kind = np.uint16 if max(c.max(initial=0) for c in code) < 0xFFFF else np.uint32
    x, y = np.full((len(xs), int(max(n.max(), m.max())) + most + wide), np.iinfo(kind).max, kind), np.zeros((len(ys), int(m.max())), kind)
    for table, chars, size, at in ((x, code[0], n, most), (y, code[1], m, 0)):
        table.reshape(-1)[V.ragged(np.arange(len(size)) * table.shape[1] + at, size)] = chars
    who = np.arange(len(xs))
    plus, minus = np.full(len(xs), int(mask) ^ ((1 << most) - 1), _U), np.zeros(len(xs), _U)
    score = np.minimum(most, n)
    shortest, first_end = int(n.min()), int(m.min())
    good = []
    for column in range(int(m.max())):
        equal = np.packbits(x[:, column : column + wide] == y[:, column, None], axis=1, bitorder="little").view(f"<u{wide // 8}").ravel().astype(_U)
        diagonal = ((((equal & plus) + plus) ^ plus) | equal | minus) & mask
        rise, fall = minus | ~(diagonal | plus) & mask, diagonal & plus
        step = 1 - (diagonal >> top & _U(1)).astype(np.int64)
        if column + most >= shortest:  # the last row of some matrix is in its band
            bit = (n - 1 - column + most).clip(0, 63).astype(_U)
            last = (rise >> bit & _U(1)).astype(np.int64) - (fall >> bit & _U(1)).astype(np.int64)
            step = np.where(column + most < n, step, last)
        score = score + step
        down = diagonal >> _U(1)
        plus, minus = (fall | ~(down | rise)) & mask, down & rise
        ending = column + 1 >= first_end
        if ending:
            ended = m == column + 1
            good.extend(who[ended & (score <= limit)].tolist())
        if ending or column % 16 == 15:
            left = np.where(column + most < n, most + m - n, m - column - 1)
            stay = (m > column + 1) & (score - left <= limit)
            if not stay.any():
                break
            if not stay.all():
                who, x, y, n, m, limit, plus, minus, score = (v[stay] for v in (who, x, y, n, m, limit, plus, minus, score))
                shortest, first_end = int(n.min()), int(m.min())
    return np.array(good, np.int64)


def _near(members: DataFrame, sketches: DataFrame, sharing: DataFrame, edits: int, per: int | None) -> DataFrame:
    """Links (a, b) of each member of a bucket with its centre. Lengths and tallies are compared first, so that few lines are fetched."""
    pairs = members.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()

    @F.pandas_udf("boolean")
    def alike(m: pd.Series, n: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        limit = np.array([allowed(k, edits, per) for k in np.minimum(m, n).tolist()], np.int64)
        x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, 64).astype(np.int16) for v in (x, y))
        return pd.Series((np.abs(m.to_numpy() - n.to_numpy()) <= limit) & (np.abs(x - y).sum(axis=1) <= 2 * limit))

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(near_lines(x.tolist(), y.tolist(), edits, per), dtype=bool)

    def side(node: str, size: str, tally: str) -> DataFrame:
        return sketches.select(F.col("node").alias(node), F.col("size").alias(size), F.col("tally").alias(tally))

    sketched = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b")
    likely = written(sketched.where(F.abs(F.col("m") - F.col("n")) <= edits).where(alike("m", "n", "x", "y")).select("a", "b").distinct(), "likely")
    release(members.sparkSession)
    lines = _fetched(sharing, likely.select(F.explode(F.array("a", "b")).alias("node")))
    both = likely.join(lines.select(F.col("node").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
    near_ones = written(both.where(near("x", "y")).select("a", "b").distinct(), "near")
    forget(likely, lines)
    release(members.sparkSession)
    return near_ones


def _spread(mixed: DataFrame) -> DataFrame:
    """bucket, node, component, chunk, i, j: members of a bucket dealt into `chunks` (a column), and each where chunks i and j are compared."""
    dealt = mixed.withColumn("chunks", F.col("chunks").cast("int")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    spread = dealt.select("bucket", "node", "component", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    return spread.select("bucket", "node", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))


def _in_groups(spread: DataFrame, others: DataFrame, tasks: int, compare, schema: str) -> DataFrame:
    """What `compare` gives for the rows of spread, joined with others by their nodes, and where their groups (bucket, i, j) start."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Groups may go on from one batch to the next: the last one of a batch waits.
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            key = frame[["bucket", "i", "j"]].to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            if len(edge) > 1:
                yield compare(frame.iloc[: edge[-1]], edge)
            held = frame.iloc[edge[-1] :]
        if held is not None and len(held):
            yield compare(held, np.array([0, len(held)]))

    parts = max(int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    return spread.join(others, "node").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInPandas(run, schema)


def _alike(mixed: DataFrame, sketches: DataFrame, edits: int, per: int | None) -> DataFrame:
    """The rows of mixed (bucket, node, component, and how many the bucket has) that lengths and tallies leave near a row of their bucket that is of another class, and the bytes of their lines.

    Two lines that may be near have a row in each bucket that both are in, so _inside finds the links among these rows that it finds among all.
    """
    rows = mixed.count()
    found = _in_groups(_spread(mixed.withColumn("chunks", F.ceil(F.col("members") / BLOCK))), sketches.select("node", "size", "bytes", "tally"), -(-rows // 8000), lambda rows, edge: _paired(rows, edge, edits, per), "bucket long, node long, component long, bytes long")
    return found.distinct()


def _inside(mixed: DataFrame, sharing: DataFrame, edits: int, per: int | None) -> DataFrame:
    """Links between classes inside buckets that have several. mixed: bucket, node, component, bytes.

    A bucket's members are dealt into chunks of bounded number and bytes, and a task compares two chunks. A pair is compared in the least of the
    buckets that it shares.
    """
    lines = _fetched(sharing, mixed.select("node"))
    buckets = mixed.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))  # as many as a line has keys
    chunks = mixed.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / F.lit(BLOCK_BYTES))).alias("chunks"))
    spread = written(_spread(mixed.join(chunks.hint("shuffle_hash"), "bucket")), "spread")
    found = _in_groups(spread, lines.join(buckets, "node"), -(-spread.count() // 8000), lambda rows, edge: _compared(rows, edge, edits, per), "a long, b long")
    out = written(found.distinct(), "inside")
    forget(lines, spread)
    return out


def _pairs(edge: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group, as numbers. edge: where groups start, and the end of the last; own: the rows' classes, which may become fewer meanwhile."""
    many = np.diff(edge)
    small = np.repeat(many <= 48, many)
    group = np.repeat(np.arange(len(many)), many)
    for d in range(1, int(many[many <= 48].max(initial=1))):
        p = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        yield p, p + d
    for g in np.flatnonzero(many > 48).tolist():
        at = np.arange(edge[g], edge[g + 1])
        label, where = np.unique(own[at], return_inverse=True)
        main = where == np.bincount(where).argmax()  # members of the largest class needn't be compared with each other
        for p in at[~main].tolist():
            q = at[main | (at > p)]
            yield np.full(len(q), p), q


def _possible(rows: pd.DataFrame, own: np.ndarray, size: np.ndarray, tally: np.ndarray, edits: int, per: int | None):
    """A function that leaves of pairs of rows those of two classes, and of two chunks if the group has two, that lengths and tallies leave near."""
    chunk, across = rows["chunk"].to_numpy(), rows["i"].to_numpy() != rows["j"].to_numpy()
    most = np.array([allowed(n, edits, per) for n in size.tolist()])

    def leave(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        limit = np.minimum(most[p], most[q])
        some = (own[p] != own[q]) & (~across[p] | (chunk[p] != chunk[q])) & (np.abs(size[p] - size[q]) <= limit)
        p, q, limit = p[some], q[some], limit[some]
        some = np.abs(tally[p] - tally[q]).sum(axis=1) <= 2 * limit
        return p[some], q[some]

    return leave


def _paired(rows: pd.DataFrame, edge: np.ndarray, edits: int, per: int | None) -> pd.DataFrame:
    """The rows of groups that are in a pair that _possible leaves."""
    own, size = rows["component"].to_numpy(), rows["size"].to_numpy()
    tally = np.frombuffer(b"".join(rows["tally"]), np.uint8).reshape(-1, 64).astype(np.int16)
    leave, seen = _possible(rows, own, size, tally, edits, per), np.zeros(len(rows), bool)
    for p, q in _pairs(edge, own):
        new = ~(seen[p] & seen[q])
        p, q = leave(p[new], q[new])
        seen[p] = seen[q] = True
    return rows.loc[seen, ["bucket", "node", "component", "bytes"]]


def _compared(rows: pd.DataFrame, edge: np.ndarray, edits: int, per: int | None) -> pd.DataFrame:
    """Links between classes among the lines of each group (one bucket, or two chunks of one). edge: where groups start, and the end of the last."""
    line, node, bucket = rows["line"].tolist(), rows["node"].to_numpy(), rows["bucket"].to_numpy()
    shared, own = [frozenset(b.tolist()) for b in rows["buckets"]], rows["component"].to_numpy().copy()
    leave = _possible(rows, own, np.array([len(x) for x in line]), tallies(line), edits, per)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    found: list[tuple[int, int]] = []

    def consider(p: np.ndarray, q: np.ndarray) -> None:
        """Pairs of one group: those that may be near wait to be verified, each in the least bucket that both lines are in."""
        p, q = leave(p, q)
        first = np.fromiter((min(shared[i] & shared[j]) for i, j in zip(p.tolist(), q.tolist())), np.int64, len(p)) == bucket[p]
        if first.any():
            waiting.append((p[first], q[first]))
            if sum(len(x) for x, _ in waiting) >= 2048:
                decide()

    def decide() -> None:
        pairs = [np.concatenate(x) for x in zip(*waiting)] if waiting else [np.zeros(0, np.int64)] * 2
        waiting.clear()
        for at in range(0, len(pairs[0]), 2048):
            p, q = (x[at : at + 2048] for x in pairs)
            apart = own[p] != own[q]
            p, q = p[apart], q[apart]
            close = near_lines([line[i] for i in p], [line[i] for i in q], edits, per)
            for i, j in zip(p[close].tolist(), q[close].tolist()):
                if own[i] != own[j]:
                    own[own == max(own[i], own[j])] = min(own[i], own[j])
                    found.append((node[i], node[j]))

    for p, q in _pairs(edge, own):
        consider(p, q)
    decide()
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, per: int | None = PER) -> DataFrame:
    """rid, doc_id, line_no (from 0), line_id, class_id, copies, kept of every line with a character that isn't white space.

    Lines of a class are linked by chains of insertions, deletions and replacements of characters, in each link at most one for each `per` characters of
    the shorter line (rounded) and at most `edits`. line_id is the md5 of the line's UTF-8 bytes; copies counts lines equal to this one. One line of a class is
    kept: the first by doc_id (nulls first), row and number; class_id is its line_id. Null and empty texts have no lines. Rows may repeat: rid tells rows of
    the same doc_id apart. Long texts and lines are taken whole. An empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return _classes(rows, edits, per)


def _classes(rows: DataFrame, edits: int, per: int | None) -> DataFrame:
    line = F.col("line")
    each = rows.select("rid", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where((line >= "!") & (line < "\x80") | line.rlike(INK))  # most begin with ink of ASCII
    lines = written(each.select("rid", "doc_id", F.col("line_no").cast("long").alias("line_no"), F.unhex(F.md5(line.cast("binary"))).alias("id")), "lines")
    members, sketches, sharing = _members(rows, edits, per)
    links = _near(members, sketches, sharing, edits, per)
    found = written(components(links), "components")
    # A bucket of two is decided, since one of them is its centre.
    large = members.where("size > 2").select("bucket", "node", F.col("size").alias("members")).join(found.hint("shuffle_hash"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = large.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    mixed = written(large.join(apart.hint("shuffle_hash"), "bucket"), "apart")
    forget(members, links)
    release(rows.sparkSession)
    alike = written(_alike(mixed, sketches, edits, per), "alike")
    forget(mixed)
    release(rows.sparkSession)
    more = _inside(alike, sharing, edits, per)
    if not more.isEmpty():
        found = written(extended(found, more), "components")
    named = sketches.select("node", F.col("line_id").alias("id")).join(found, "node").select("id", F.col("component").cast("string").cast("binary").alias("class"))
    # Of a line that comes once these are its own numbers.
    totals = lines.groupBy("id").agg(F.count("*").alias("copies"), F.min("rid").alias("rid"), F.min("doc_id").alias("doc_id"), F.min("line_no").alias("line_no"))
    totals = written(totals.join(named.hint("shuffle_hash"), "id", "left"), "totals")
    forget(sketches, sharing, alike, more, found)  # the result reads the other tables
    release(rows.sparkSession)
    alone = (F.col("copies") == 1) & F.col("class").isNull()
    columns = "rid", "doc_id", "line_no", "id", "class_id", "copies", "kept"
    single = totals.where(alone).withColumns({"class_id": F.col("id"), "kept": F.lit(True)}).select(*columns)
    several = totals.where(~alone).select("id", "copies", F.coalesce("class", "id").alias("class"))
    first = lines.join(several.select("id", "class").hint("shuffle_hash"), "id").groupBy("class").agg(F.min(F.struct("doc_id", "rid", "line_no", "id")).alias("least"))
    kept = F.col("rid").eqNullSafe(F.col("least.rid")) & (F.col("line_no") == F.col("least.line_no"))
    others = lines.join(several.join(first, "class").select("id", "copies", "least").hint("shuffle_hash"), "id").withColumns({"class_id": F.col("least.id"), "kept": kept}).select(*columns)
    out = single.unionByName(others)
    return out.select("rid", "doc_id", "line_no", F.lower(F.hex("id")).alias("line_id"), F.lower(F.hex("class_id")).alias("class_id"), "copies", "kept")


def clean(docs: DataFrame, edits: int = EDITS, per: int | None = PER) -> DataFrame:
    """docs without the lines that aren't kept, n_chars set anew; documents that had lines and lose all of them go. Other columns stay, whatever their names."""
    key, gone = free(docs, "chronofold_rid"), free(docs, "chronofold_gone")
    some = free(docs, gone + "_some")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = _classes(rows.select(col(key).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), edits, per)
    lost = found.groupBy(F.col("rid").alias(key)).agg(F.collect_list(F.when(~F.col("kept"), F.col("line_no"))).alias(gone), F.max("kept").alias(some))
    out = rows.join(lost, key, "left").where(F.coalesce(col(some), F.lit(True)))
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def without(text: pd.Series, numbers: pd.Series) -> pd.Series:
        def rest(t, n):
            if t is None or n is None or not len(n):
                return t
            away = set(n.tolist())
            return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in away)

        return pd.Series([rest(t, n) for t, n in zip(text, numbers)], dtype=object)

    changed = F.coalesce(F.size(gone), F.lit(0)) > 0
    out = out.withColumn("text", without(F.col("text").cast("string"), col(gone)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[col(c) for c in docs.columns])


def op3_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid")
