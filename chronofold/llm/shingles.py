"""Sets of word shingles of whole texts, and their circulant MinHash signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from chronofold.llm import textvec as V

_U = np.uint64
#: Size of the space that shingles are mapped to before the second permutation is applied.
SPACE = 1 << 20
#: Elements whose shifted values are held at once.
BLOCK = 500


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of whole texts: (index of each text that has words, where its set starts, all sets one after the other, each sorted).

    A set has the distinct sequences of `width` words, or the whole sequence of a text with fewer words.
    """
    for row, word in V.words(texts):
        if not len(row):
            continue
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.concatenate([first, [len(row)]]))
        # The value of a sequence is the same sum wherever it starts; a sequence of another length has other factors.
        value = np.zeros(len(word), _U)
        rest = np.repeat(first + size, size) - np.arange(len(word))
        for k in range(width):
            shifted = np.concatenate([word[k:], np.zeros(min(k, len(word)), _U)])
            value += np.where(rest > k, V.mix(shifted + _U(k + 1)), _U(0))
        whole = np.repeat(size, size) < width
        value = V.mix(value + np.minimum(np.repeat(size, size), width).astype(_U))
        inside = np.where(whole, np.arange(len(word)) == np.repeat(first, size), rest >= width)
        text = np.repeat(np.arange(len(first)), size)[inside]
        value = value[inside]
        order = np.argsort(value, kind="stable")
        order = order[np.argsort(text[order], kind="stable")]
        text, value = text[order], value[order]
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])])
        text, value = text[new], value[new]
        yield row[first], np.searchsorted(text, np.arange(len(first))), value


def bands_for(threshold: float, rows: int, miss: float = 1e-6) -> int:
    """So many bands of so many rows miss a pair at the threshold with at most that probability."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


@lru_cache(4)
def second_permutation(coordinates: int, seed: int) -> np.ndarray:
    """A permutation of the space; row x of the result has its values at x, x+1, ... (circular): one shift for each coordinate."""
    values = np.random.default_rng(seed).permutation(SPACE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: coordinates - 1]]), coordinates)


def signatures(start: np.ndarray, value: np.ndarray, coordinates: int, seed: int = 7) -> np.ndarray:
    """Circulant MinHash: sigma scatters the elements over the space, then every coordinate is the least value of pi under another circular shift."""
    table = second_permutation(coordinates, seed)
    place = (V.mix(value ^ _U(seed)) >> _U(64 - 20)).astype(np.int64)
    out = np.full((len(start), coordinates), np.iinfo(np.uint32).max, np.uint32)
    end = np.concatenate([start[1:], [len(value)]])
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
        for at in range(a, b, BLOCK):
            np.minimum(out[i], table[place[at : min(at + BLOCK, b)]].min(axis=0), out=out[i])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature; equal keys of different bands don't occur by design."""
    key = np.zeros((len(signature), bands), _U) + V.mix(np.arange(1, bands + 1, dtype=_U))
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    for r in range(rows):
        key = V.mix(key ^ (parts[:, :, r].astype(_U) + _U(r << 33)))
    return key
