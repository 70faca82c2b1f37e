"""Hashed character n-grams of the words of whole texts, by array operations over the distinct words of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.llm import textvec as V
from chronofold.llm.common import stored

#: Learning and evaluation are split by crc32(doc_id as text) mod this; this remainder is held out.
FOLDS, HELD_OUT = 3, 1


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; so is one without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def word_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For groups of words: (text of each distinct pair, its word, how often, (bytes, start, end) of each distinct word).

    Pairs of a text that is longer than a group appear once in each of its groups.
    """
    for data, at, rows in V.parts(texts):
        start, end = V.spans(data, V.WHITE)
        if not len(start):
            continue
        key = V.hashes(data, start, end, fold=True)
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        row = rows[np.searchsorted(at, start, "right") - 1]
        pair, times = np.unique(row * len(one) + back, return_counts=True)
        yield pair // len(one), pair % len(one), times, [data, start[one], end[one]]


def word_grams(word: list[np.ndarray], least: int, most: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams of each word, one word after the other; how many each has). A word is marked at both ends; n counts characters, in lower case."""
    data, start, end = word
    joined = np.full(int((end - start + 1).sum()), 10, np.uint8)  # no word has a line feed
    joined[V.ragged(np.cumsum(end - start + 1) - (end - start + 1), end - start)] = data[V.ragged(start, end - start)]
    code = np.frombuffer(joined.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    stop = np.flatnonzero(code == 10)
    start = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64)
    size = stop - start
    place = np.concatenate([[0], np.cumsum(size + 2)[:-1]]).astype(np.int64)
    marked = np.full(int((size + 2).sum()), 32, np.uint64)
    marked[V.ragged(place + 1, size)] = code[V.ragged(start, size)]
    marked = V.mix(marked + np.uint64(1))
    counts = [np.maximum(size + 2 - n + 1, 0) for n in range(least, most + 1)]
    total = np.sum(counts, axis=0, dtype=np.int64)
    out, at = np.zeros(int(total.sum()), np.int64), np.cumsum(total) - total
    value = np.zeros(len(marked), np.uint64)  # of the n characters from each place on
    for n in range(1, most + 1):
        value = value[: len(marked) - n + 1] * np.uint64(0x9DDFEA08EB382D69) + marked[n - 1 :]
        if n >= least:
            many = counts[n - least]
            out[V.ragged(at, many)] = (V.mix(value + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)[V.ragged(place, many)]
            at = at + many
    return out, total


class WordStore:
    """What `make` gives for words, kept by the hash of the word, so that a word is worked on once however often it comes.

    make: of distinct words, (values of all words, one word after the other; how many each has). The store is emptied when it has `most` words.
    """

    def __init__(self, make: Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]], most: int = 300_000):
        self.make, self.most = make, most
        self._clear()

    def _clear(self) -> None:
        self.key, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.values, self.used = np.zeros(0), 0

    def slots(self, key: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where distinct words lie in `at` and `size`; those that aren't known are made."""
        if len(self.key) + len(key) > self.most:
            self._clear()
        place = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        new = self.key[place] != key if len(self.key) else np.ones(len(key), bool)
        if new.any():
            values, size = self.make([data, start[new], end[new]])
            if not self.used or self.used + len(values) > len(self.values):
                room = np.zeros((max(len(values), self.used // 2, 1 << 16), *values.shape[1:]), values.dtype)
                self.values = np.concatenate([self.values[: self.used], room]) if self.used else room
            self.values[self.used : self.used + len(values)] = values
            where = np.searchsorted(self.key, key[new])
            self.key, self.slot = np.insert(self.key, where, key[new]), np.insert(self.slot, where, len(self.at) + np.arange(len(size)))
            self.at, self.size = np.concatenate([self.at, self.used + np.cumsum(size) - size]), np.concatenate([self.size, size])
            self.used += len(values)
        return self.slot[np.searchsorted(self.key, key)]

    def words(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For groups of words: (text of each distinct pair, slot of its word, how often). Texts ascend; one longer than a group goes on in the next."""
        for data, at, rows in V.parts(texts, V.CHUNK // 2):
            start, end = V.spans(data, V.WHITE)
            if not len(start):
                continue
            key, one, back = np.unique(V.hashes(data, start, end, fold=True), return_index=True, return_inverse=True)
            slot = self.slots(key, data, start[one], end[one])
            row = rows[np.searchsorted(at, start, "right") - 1]
            pair, times = np.unique(row * len(one) + back, return_counts=True)
            yield pair // len(one), slot[pair % len(one)], times

    def distinct(self, texts: pa.Array, space: int) -> Iterator[tuple[int, np.ndarray]]:
        """(text, its distinct values) of each text that has words; values are whole numbers under `space`."""
        last, going, held = np.zeros(space, np.int32), -1, np.zeros(0, np.int64)

        def unique(values: np.ndarray) -> np.ndarray:
            order = np.arange(len(values), dtype=np.int32)
            last[values] = order  # of equal values the last one wins
            return values[last[values] == order]

        for row, slot, _ in self.words(texts):
            size = self.size[slot]
            flat = self.values[V.ragged(self.at[slot], size)]
            edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
            stop = np.concatenate([[0], np.cumsum(size)])[edge]
            for i, a, b in zip(row[edge[:-1]].tolist(), stop[:-1].tolist(), stop[1:].tolist()):
                if i != going:
                    if going >= 0:
                        yield going, held
                    going, held = i, unique(flat[a:b])
                else:
                    held = unique(np.concatenate([held, flat[a:b]]))
        if going >= 0:
            yield going, held


@stored(4)
def gram_store(least: int, most: int, bits: int) -> WordStore:
    """The n-grams of words, kept for all tasks of a Python worker."""

    def make(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        gram, size = word_grams(words, least, most, bits)
        return gram.astype(np.int32), size

    return WordStore(make)


def distinct(texts: pa.Array, least: int, most: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket, count) of the distinct n-grams of each text, for groups of whole texts in order."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for row, word, times, words in word_counts(texts):
        if held and row[0] != held[-1][0][-1]:
            yield _merged(held, bits)
            held = []
        gram, many = word_grams(words, least, most, bits)
        at = np.cumsum(many) - many
        size = many[word]
        key, back = np.unique(np.repeat(row << bits, size) | gram[V.ragged(at[word], size)], return_inverse=True)
        held.append((key >> bits, key & ((1 << bits) - 1), np.bincount(back, np.repeat(times, size), len(key))))
    if held:
        yield _merged(held, bits)


def _merged(held, bits):
    if len(held) == 1:
        return held[0]
    row, gram, times = map(np.concatenate, zip(*held))
    key, back = np.unique(row << bits | gram, return_inverse=True)
    return key >> bits, key & ((1 << bits) - 1), np.bincount(back, times, len(key))
