"""Words of many texts at once: spans and 64-bit hashes by array operations over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; longer texts are taken in parts that end at white space.
CHUNK = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but digits and letters; every byte of a longer UTF-8 sequence belongs to a word.
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(_U)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(2)
def byte_values(fold: bool) -> np.ndarray:
    """A random number for each byte; with fold, A-Z have those of a-z."""
    v = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
    if fold:
        v[65:91] = v[97:123]
    return v


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0 to n-1, and their inverses modulo 2 to the 64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + (CHUNK >> 3))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)]), dtype=_U) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def parts(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into byte buffers of about a size: (bytes, where each part starts, which text it belongs to).

    Every part is followed by a line feed. Nulls count as empty. A text above the size is cut after white space, if it has any.
    """
    held: list[bytes] = []
    rows: list[int] = []
    total = 0
    for i, value in enumerate(texts.cast(pa.binary()).to_pylist()):
        at = 0
        value = value or b""
        while True:
            end = len(value)
            if end - at > size:
                cut = max(value.rfind(b" ", at, at + size), value.rfind(b"\n", at, at + size))
                if cut < 0:
                    cut = min((c for c in (value.find(b" ", at), value.find(b"\n", at)) if c >= 0), default=end - 1)
                end = cut + 1
            held.append(value[at:end])
            rows.append(i)
            total += end - at + 1
            if total >= size:
                yield _joined(held, rows)
                held, rows, total = [], [], 0
            at = end
            if at >= len(value):
                break
    if held:
        yield _joined(held, rows)


def _joined(held: list[bytes], rows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, held), np.int64, len(held)) + 1
    return np.frombuffer(b"\n".join(held) + b"\n", np.uint8), np.cumsum(lengths) - lengths, np.array(rows, np.int64)


def spans(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end. The last byte must be a separator."""
    sep = separators[data]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if len(data) and not sep[0]:
        edge = np.concatenate([[0], edge])
    return edge[::2], edge[1::2]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    if not len(start):
        return np.zeros(0, _U)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.multiply(byte_values(fold)[data], up[: len(data)], out=total[1:])
    np.cumsum(total, out=total)
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U) * _U(0xA24BAED4963EE407))


def words(texts: pa.Array, separators: np.ndarray = WHITE, fold: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For whole texts in groups: (index of the text, hash) of every word, in order. Groups end where texts end."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    n = len(texts)
    last = -1
    for data, at, rows in parts(texts):
        start, end = spans(data, separators)
        row = rows[np.searchsorted(at, start, "right") - 1]
        if kept and rows[0] != last:
            yield tuple(map(np.concatenate, zip(*kept)))
            kept = []
        kept.append((row, hashes(data, start, end, fold)))
        last = rows[-1]
    if kept or not n:
        yield tuple(map(np.concatenate, zip(*kept))) if kept else (np.zeros(0, np.int64), np.zeros(0, _U))


def ragged(offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions offset[i], offset[i]+1, ... of every piece, one piece after the other."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(offset - (total - length), length)
