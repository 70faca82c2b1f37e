"""Token ids of whole texts by a public tokenizer, each distinct word encoded once per task."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from chronofold.llm import textvec as V
from chronofold.llm.common import stored

#: Bytes of text that are worked on at once: less than elsewhere, since a word's arrays stand beside the store and the tokenizer.
PART = V.CHUNK // 4
#: Slots (2 to this) in which a word is looked up before it is searched for.
LAST_BITS = 21
#: Marks at the end of a word that are taken off; with more of them it stays whole.
MARKS = 8
#: What a tokenizer must do before its model for words to be taken in lower case and in pieces.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_ASCII = [chr(b) if b < 0x80 else "" for b in range(256)]
_LETTER = np.array([c.isalpha() for c in _ASCII])
_ALNUM = np.array([c.isalnum() for c in _ASCII])
_MARK = np.array([c > " " and c != "\x7f" and not c.isalnum() for c in _ASCII])
#: Lower case of ASCII bytes, and of the second bytes of Latin-1 letters (U+00C0 to U+00FF, whose first byte is C3).
_LOWER, _LOWER_LATIN = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER_LATIN[[*range(0x80, 0x97), *range(0x98, 0x9F)]] += 0x20


def _latin(data: np.ndarray) -> np.ndarray:
    """Where second bytes of Latin-1 letters are."""
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    return at[(data[at] != 0x97) & (data[at] != 0xB7)]  # the signs of times and division


class Encoder:
    """Ids of texts under a tokenizer that splits at ASCII white space and drops it.

    For such a tokenizer the ids of a text are those of its white-space separated words, one after the other, so
    each word is given to the tokenizers library once and its ids are kept. The store of words is emptied when it has `most`.

    If the tokenizer makes texts lower case and splits them as _SPLIT does, words differ less: they are taken in lower case (those of ASCII and Latin-1 letters,
    which no normalization joins with their neighbours), and marks at the end after a letter or digit, a piece of their own for the tokenizer, too, are taken off.
    A word of such letters alone is one piece, which the model gets without the steps before it. Marks of added tokens, which are looked for
    before all these steps, are left where they are, and words with them as they are.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        # A worker has one core; the library's threads, one for each core of the machine, would keep some 36 MB of memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        added = "".join(x["content"] for x in steps["added_tokens"])
        marks = [ord(c) for c in added if not c.isalnum() and c.isascii()]
        suffix = steps["model"].get("end_of_word_suffix") == "</w>" and all(not x["content"].isalnum() and x["content"].isascii() for x in steps["added_tokens"])
        self.known = suffix and (steps["normalizer"], steps["pre_tokenizer"]) == (_NORMALIZER, _PRE_TOKENIZER)
        self.mark, self.keep = _MARK.copy(), np.array([b >= 0x80 for b in range(256)])
        self.mark[marks], self.keep[marks] = False, True
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")]] = True
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.key, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of words, and their numbers
        self.name, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # by number
        self.last = np.zeros(1 << LAST_BITS, np.int32)  # the number of a word that was looked up last, by the first bits of its hash
        self.ids = np.zeros(0, np.uint32)
        self.used = self.words = 0

    def _together(self, key: np.ndarray, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> None:
        """Words in lower case of ASCII and Latin-1 letters alone are one piece for the tokenizer, whose last id is one with the end mark; so many fit in one call."""
        size = stop - begin
        end = np.cumsum(size + 1)
        joined = np.full(int(end[-1]), 0x20, np.uint8)
        joined[V.ragged(end - size - 1, size)] = data[V.ragged(begin, size)]
        text, edge = joined.tobytes(), [0, *end[199:-1:200].tolist(), int(end[-1])]
        found = self.plain.encode_batch_fast([text[a : b - 1].decode() for a, b in zip(edge, edge[1:])], add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        self._store(key, np.diff(np.flatnonzero(self.ends[flat]), prepend=-1), flat)

    def _store(self, key: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(flat), self.used // 2, 1 << 16), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        place, number = np.searchsorted(self.key, key), self.words + np.arange(len(key))
        self.key, self.number = np.insert(self.key, place, key), np.insert(self.number, place, number)
        if self.words + len(key) > len(self.name):
            room = max(len(key), self.words // 2, 1 << 14)
            self.name, self.at, self.size = (np.concatenate([x[: self.words], np.zeros(room, x.dtype)]) for x in (self.name, self.at, self.size))
        new = slice(self.words, self.words + len(key))
        self.name[new], self.at[new], self.size[new] = key, self.used + np.cumsum(size) - size, size
        self.words += len(key)
        self.used += len(flat)

    def _numbers(self, key: np.ndarray, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The number of each word; those that aren't known are encoded."""
        slot = (key >> np.uint64(64 - LAST_BITS)).astype(np.int64)
        number = self.last[slot].astype(np.int64)
        other = np.flatnonzero(self.name[number] != key) if self.words else np.arange(len(key))
        if not len(other):
            return number
        unique, one, back = np.unique(key[other], return_index=True, return_inverse=True)
        if len(self.key) + len(unique) > self.most and len(self.key):
            self._clear()
            return self._numbers(key, data, begin, stop)
        place = np.minimum(np.searchsorted(self.key, unique), max(len(self.key) - 1, 0))
        new = self.key[place] != unique if len(self.key) else np.ones(len(unique), bool)
        if new.any():
            fresh, first, last = unique[new], begin[other[one[new]]], stop[other[one[new]]]
            plain = self._of_letters(data, first, last)
            if plain.any():
                self._together(fresh[plain], data, first[plain], last[plain])
            if not plain.all():
                raw = data.tobytes()
                rest = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(first[~plain].tolist(), last[~plain].tolist())], add_special_tokens=False)
                ids = [e.ids for e in rest]
                self._store(fresh[~plain], np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter((x for y in ids for x in y), np.uint32))
        found = self.number[np.searchsorted(self.key, unique)]
        self.last[unique >> np.uint64(64 - LAST_BITS)] = found
        number[other] = found[back]
        return number

    def _of_letters(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which words may be given to _together."""
        if not self.known:
            return np.zeros(len(begin), bool)
        size = stop - begin
        data = data[V.ragged(begin, size)]
        letter, at = _LETTER[data], _latin(data)
        letter[at] = letter[at - 1] = True
        return np.logical_and.reduceat(letter, np.cumsum(size) - size)

    def _lowered(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The bytes with words in lower case, but for those with other characters than ASCII and Latin-1 letters, or marks of added tokens."""
        out, at, other = _LOWER[data], _latin(data), self.keep[data]
        out[at] = _LOWER_LATIN[data[at]]
        other[at] = other[at - 1] = False
        other = np.flatnonzero(other)
        if len(other):
            word = np.unique(np.searchsorted(start, other, "right") - 1)
            place = V.ragged(start[word], end[word] - start[word])
            out[place] = data[place]
        return out

    def _pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end if up to MARKS marks after a last letter or digit are words of their own."""
        cut = np.zeros(len(start), np.int64)  # where such marks begin
        word = np.flatnonzero(self.mark[data[end - 1]])
        at = end[word] - 1
        for _ in range(MARKS):
            at -= 1
            inner = at >= start[word]
            word, at = word[inner], at[inner]
            last = data[at]
            found = _ALNUM[last]
            found |= (data[at - 1] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (at > 0)
            cut[word[found]] = at[found] + 1
            more = self.mark[last]
            word, at = word[more], at[more]
            if not len(word):
                break
        some = np.flatnonzero(cut)
        if not len(some):
            return start, end
        many = np.ones(len(start), np.int64)
        many[some] = 2
        begin, stop, at = np.repeat(start, many), np.repeat(end, many), some + np.arange(1, len(some) + 1)
        begin[at] = stop[at - 1] = cut[some]
        return begin, stop

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For groups of words in order: (index of the text, number of ids) of each word, all ids one after the other."""
        for data, at, rows in V.parts(texts, PART):
            start, end = V.spans(data, V.WHITE)
            if not len(start):
                continue
            begin, stop = start, end
            if self.known:
                data = self._lowered(data, start, end)
                begin, stop = self._pieces(data, start, end)
            number = self._numbers(V.hashes(data, begin, stop, fold=False), data, begin, stop)
            size = self.size[number]
            yield np.repeat(rows, np.diff(np.searchsorted(begin, at), append=len(begin))), size, self.ids[V.ragged(self.at[number], size)]

    def documents(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
        """(index, ids with the end id) of every text, in order; empty texts and nulls have the end id alone."""
        held: dict[int, list[np.ndarray]] = {}
        done = 0
        tail = np.array([end_id], np.uint32)
        for row, size, ids in self.encode(texts):
            edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            stop = np.concatenate([np.cumsum(size)[edge[1:] - 1], [len(ids)]]).astype(np.int64)
            for i, a, b in zip(row[edge].tolist(), np.concatenate([[0], stop[:-1]]).astype(int).tolist(), stop.tolist()):
                while done < i:
                    yield done, np.concatenate([*held.pop(done, []), tail])
                    done += 1
                held.setdefault(i, []).append(ids[a:b])
        while done < len(texts):
            yield done, np.concatenate([*held.pop(done, []), tail])
            done += 1


@stored(2)
def encoder(path: str, most: int = 1_000_000) -> Encoder:
    """One encoder for all tasks of a Python worker, so that words stay known from task to task."""
    return Encoder(path, most)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def word_tokenizer() -> str:
    """Where the public word-level BPE vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary_size(path: str) -> int:
    """One more than the greatest id of a tokenizer."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=-1) + 1
