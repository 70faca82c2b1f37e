import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from chronofold.llm import shingles, textvec
from chronofold.llm.decontaminate import Automaton
from chronofold.llm.encode import Encoder, word_tokenizer
from chronofold.llm.html_text import main_text
from chronofold.llm.lines import edit_distance, line_entries, near_lines
from chronofold.llm.packing import cuts, leftovers
from chronofold.llm.repair import Block, pack_block


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


@pytest.mark.parametrize("chunk", [1 << 20, 150])
def test_words_one_by_one_have_the_ids_of_the_whole_text(tokenizer, chunk, monkeypatch):
    monkeypatch.setattr(textvec.parts, "__defaults__", (chunk,))
    r = random.Random(3)
    letters = [*"abcdeXYZ é'ß,.!?;:…  \t\n ́ ñ12-–’\"|<>KK😀ΣÅ", "'s", "'re", "<|endoftext|>", " the "]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)] + [None, "", " ", "x" * 5000]
    for most in (1_000_000, 300):
        found = [ids.tolist() for _, ids in Encoder(word_tokenizer(), most).documents(pa.array(texts), 1)]
        assert found == [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 60_000])
def test_blocks_round_trip_and_give_any_stretch(n):
    r = np.random.default_rng(n)
    texts = [np.append(r.zipf(1.3, n) % 3000 + 2, 1).astype(np.uint32) for _ in range(3)] + [np.array([1], np.uint32)]
    block = Block.read(data := pack_block([1, None, -3, 4], texts, 49_408, 1))
    assert all(d == e and np.array_equal(x, y) for (d, x), e, y in zip(block.documents(), [1, None, -3, 4], texts))
    for _ in range(20):
        a, b = sorted(r.integers(0, n + 2, 2))
        assert np.array_equal(block.tokens(2, a, b), texts[2][a:b])
    if n > 10_000:
        assert len(data) < 2 * sum(map(len, texts)) and len(block.rules)
    with pytest.raises(ValueError):
        Block.read(data[:-1] + bytes([data[-1] ^ 1]))


def levenshtein(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p = d[:]
        d[0] = i
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return d[-1]


def edited(r, a, most):
    b = list(a)
    for _ in range(most):
        k = r.random()
        if b and k < 0.34:
            b[r.randrange(len(b))] = r.choice("abé")
        elif b and k < 0.67:
            del b[r.randrange(len(b))]
        else:
            b.insert(r.randint(0, len(b)), r.choice("abé"))
    return "".join(b)


def keys_of(a, b, *options):
    """The bucket keys of two lines."""
    (name, who, key, _), = line_entries(pa.array([f"{a}\n{b}"]), *options)
    return [set(key[who == i].tolist()) for i in range(len(name))]


def test_edit_distance_and_shared_segments():
    r = random.Random(2)
    for _ in range(1500):
        a = "".join(r.choice("abé") for _ in range(r.randint(0, 25)))
        b = edited(r, a, r.randint(0, 9)) if r.random() < 0.8 else "".join(r.choice("abé") for _ in range(r.randint(0, 25)))
        for most in (0, 1, 2, 3, 8):
            assert edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)
        for most in (1, 2, 3):
            if a != b and min(len(a), len(b)) > most and levenshtein(a, b) <= most:
                x, y = keys_of(a, b, most, None)
                assert x & y


def test_near_lines_agree_with_the_plain_distance():
    r = random.Random(3)
    pairs = []
    for _ in range(800):
        a = "".join(r.choice("abé ") for _ in range(r.choice([0, 3, 9, 10, 15, 29, 30, 31, 50, 90, 170, 200])))
        pairs.append((a, edited(r, a, r.randint(0, 11))))
    got = near_lines([a for a, _ in pairs], [b for _, b in pairs], 8, 20)
    want = [levenshtein(a, b) <= min((min(len(a), len(b)) + 10) // 20, 8) for a, b in pairs]
    assert got.tolist() == want and 100 < sum(want) < 700


def test_edit_distance_of_long_lines_takes_only_the_band():
    a = "abcdefghij" * 30_000
    assert edit_distance("x" + a[:-1], a[1:] + "y", 8) <= 4
    assert edit_distance("x" + a, a[5:] + "zz", 8) == 8
    assert edit_distance(a[::-1], a, 8) == 9


def test_signatures_estimate_similarity():
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    a = [r.choice(words) for _ in range(600)]
    b = a[:450] + [r.choice(words) for _ in range(150)]
    (_, start, value), = shingles.shingle_sets(pa.array([" ".join(a), " ".join(b), "", None, "one two"]), 3)
    sets = [set(value[s:e].tolist()) for s, e in zip(start, [*start[1:], len(value)])]
    assert [len(s) for s in sets][2] == 1 and len(sets) == 3
    assert len(sets[0]) == len({tuple(a[i : i + 3]) for i in range(598)})
    s = shingles.signatures(start, value, 512)
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(float((s[0] == s[1]).mean()) - true) < 0.09
    assert (1 - 0.85**8) ** shingles.bands_for(0.85, 8) <= 1e-6


def test_automaton_equals_a_search_for_windows():
    r = random.Random(5)
    for _ in range(150):
        items = [(i, np.array([r.randint(1, 4) for _ in range(r.randint(1, 9))], np.uint64)) for i in range(r.randint(1, 6))]
        doc = [r.randint(1, 6) for _ in range(60)]
        window = r.choice([2, 3, 5])
        want, seen = set(), set()
        for i, w in items:
            n = min(window, len(w))
            for a in range(len(w) - n + 1):
                for p in range(len(doc) - n + 1):
                    if doc[p : p + n] == w[a : a + n].tolist():
                        want.update(range(p, p + n))
                        seen.add(i)
        m = Automaton(items, window)
        code, start, end = m.candidates(np.array(doc, np.uint64), np.zeros(60, np.int64))
        got, items_seen = set(), set()
        for a, b in zip(start.tolist(), end.tolist()):
            for s, e, of in m.stream(code[a:b].tolist()):
                got.update(range(a + s, a + e))
                items_seen.update(of)
        assert (got, items_seen) == (want, seen)


def test_cuts_and_leftovers():
    for n in (1, 63, 64, 100, 4095, 4096, 4097, 20_000):
        assert sum(cuts(n, 4096, 64)) == n and max(cuts(n, 4096, 64)) <= 4096
    found = leftovers({2048: 1, 1024: 3, 63: 20}, 4096)
    for b in {x[2] for x in found}:
        at = 0
        for length, _, _, place in sorted((x for x in found if x[2] == b), key=lambda x: x[3]):
            assert place == at
            at += length
        assert at <= 4096


def test_main_text():
    page = "<body><nav><a href=x>Menu</a></nav><div class='side-bar sidebar'>x</div><article><h1>T &amp; t</h1><p>One <b>two</b>\n three<p>Four<script>var a='<p>';</script><div class=ad>buy</div></article><div id=comments>c</div><footer>f</footer>"
    assert main_text(page) == "T & t\nOne two three\nFour"
    assert main_text(None) == main_text("") == main_text("<script>x") == main_text("<!-- a -->") == ""
    assert main_text("plain") == "plain" and main_text("<p>5 < 6</p>") == "5 < 6"
    assert main_text("<p>" + "long " * 100_000 + "</p>") == ("long " * 100_000).strip()
    assert zlib.crc32(b"") == 0


def test_few_rounds_of_pairs_and_words_looked_up_in_few_slots(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from chronofold.llm import encode, repair

    calls = []
    whole = repair.frequent_pairs
    monkeypatch.setattr(repair, "frequent_pairs", lambda *a: calls.append(1) or whole(*a))
    ids = np.minimum(np.random.default_rng(5).zipf(1.3, 60_000), 40_000).astype(np.uint32)
    symbols, rules, lengths = repair.compress(ids, 50_000, 1)
    assert np.array_equal(repair.expand(symbols, rules, lengths, 50_000), ids) and len(calls) < 9  # it took 9 before
    monkeypatch.setattr(encode, "LAST_BITS", 3)
    texts = ["the house, the garden. Haus und Garten!", None, "x1 y2 été " * 40, "", "a b c d e f g " + " ".join(f"{chr(97 + i % 26)}word{chr(97 + i // 26)} q" for i in range(450))]
    for most in (5, 1000):
        e = encode.Encoder(encode.word_tokenizer(), most)
        for _ in range(2):
            got = [ids.tolist() for _, ids in e.documents(pa.array(texts), 1)]
            assert got == [[*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_words_that_differ_in_case_or_marks_are_encoded_once(tokenizer):
    r = random.Random(11)
    letters = [*"abJKsTzXÀÉÞßéþÿ×÷İŒœǄΣσ0 9²  '!$&#*%.,-<|>\x00\x1c\x85\xa0̸́̌ﬁK\n", "'S", "'re", "!!", "&&&", "." * 12, "<|endoftext|>", "<|ENDOFTEXT|>", " The ", "É́"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    found = [ids.tolist() for _, ids in Encoder(word_tokenizer()).documents(pa.array(texts), 1)]
    assert found == [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    few = Encoder(word_tokenizer())
    text = "Haus haus HAUS haus, Haus!! (haus haus&&& haus... Été été ÉTÉ été. été??! x1 X1 x1!!"
    assert [ids.tolist() for _, ids in few.documents(pa.array([text]), 1)] == [tokenizer.encode(text, add_special_tokens=False).ids + [1]]
    assert few.words == 10  # haus, (haus, été, x1 and six runs of marks; it took 16 before


def test_a_tokenizer_that_tells_case_apart_gets_words_as_they_are(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.BPE({c: i for i, c in enumerate("abAB,!")}, []))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    other.save(str(tmp_path / "other.json"))
    text = "ab AB, Ab! aB!! a b"
    assert [ids.tolist() for _, ids in Encoder(str(tmp_path / "other.json")).documents(pa.array([text]), 9)] == [other.encode(text).ids + [9]]


def test_pairs_are_counted_at_all_places_only_when_the_level_falls(monkeypatch):
    from chronofold.llm import repair

    calls = []
    whole = repair.frequent_pairs
    monkeypatch.setattr(repair, "frequent_pairs", lambda *a: calls.append((a[1] is None, a[3])) or whole(*a))
    r = np.random.default_rng(8)
    for ids in (np.minimum(r.zipf(1.3, 60_000), 40_000), r.integers(2, 5, 20_000), np.full(5000, 7), np.tile([5, 5, 6, 1], 3000), np.array([1, 4]), np.array([1])):
        calls.clear()
        symbols, rules, lengths = repair.compress(ids.astype(np.uint32), 50_000, 1)
        assert np.array_equal(repair.expand(symbols, rules, lengths, 50_000), ids)
        pairs, count = np.unique(symbols[:-1].astype(np.int64) << 32 | symbols[1:], return_counts=True)
        assert not ((count >= 8) & (pairs >> 32 != 1) & (pairs & 0xFFFFFFFF != 1)).any()
        everywhere = [level for all_places, level in calls if all_places]
        assert len(everywhere) == len(set(everywhere))  # once for each level; the last was counted again and again before


def test_texts_are_encoded_in_small_parts(tokenizer, monkeypatch):
    import tracemalloc

    from chronofold.llm import encode

    r = random.Random(4)
    words = ["".join(r.choice("abcdefé.,") for _ in range(r.randint(1, 12))) for _ in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (0, 1, 30, 5000, 300_000)] + [None]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    e = Encoder(word_tokenizer())
    assert [ids.tolist() for _, ids in e.documents(pa.array(texts), 1)] == want
    tracemalloc.start()
    for _ in e.encode(pa.array(texts)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 18 << 20  # with words known already; it took 41 MB before
    monkeypatch.setattr(encode, "PART", 150)
    assert [ids.tolist() for _, ids in Encoder(word_tokenizer()).documents(pa.array(texts[:4]), 1)] == want[:4]


def test_an_encoder_starts_no_threads():
    import os
    import subprocess
    import sys

    code = """
import os
import pyarrow as pa
from chronofold.llm.encode import Encoder, word_tokenizer
e = Encoder(word_tokenizer())
before = len(os.listdir("/proc/self/task"))
for _ in e.documents(pa.array([" ".join(f"w{chr(97 + i % 26)}{i:x}{'é' * (i % 2)} {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5000))]), 1):
    pass
print(before, len(os.listdir("/proc/self/task")))
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    found = subprocess.run([sys.executable, "-c", code], env=env | {"PYTHONPATH": os.pathsep.join(sys.path)}, capture_output=True, text=True, check=True)
    before, after = found.stdout.split()[-2:]
    assert before == after  # there was one more for each core
