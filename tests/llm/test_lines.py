"""Line classes at the production setting against all pairs compared by the plain distance."""

import random
from collections import Counter
from hashlib import md5

import pytest

from chronofold.llm import lines
from tests.llm.test_text import edited, keys_of, levenshtein


def near(a, b):
    if abs(len(a) - len(b)) > 8 or sum((Counter(a) - Counter(b)).values()) > 8:
        return False
    return levenshtein(a, b) <= min((min(len(a), len(b)) + 10) // 20, 8)


def test_near_lines_share_a_key():
    r = random.Random(6)
    shared = 0
    for _ in range(600):
        a = "".join(r.choice("abcdefgé ") for _ in range(r.choice([10, 12, 20, 29, 30, 39, 40, 59, 61, 100, 149, 150, 161, 179, 180, 200, 230])))
        b = edited(r, a, min(r.randint(1, 8), (len(a) + 10) // 20))
        if a != b and len(b) >= 10 and near(a, b):
            x, y = keys_of(a, b)
            assert x & y
            shared += 1
    assert shared > 400


@pytest.mark.parametrize("block", [1000, 5])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(60)]
    base = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 3, 4, 8, 8, 14, 20, 30, 45)]
    texts = []
    for _ in range(45):
        line = r.choice(base)
        w = line.split()
        if r.random() < 0.5:
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(edited(r, " ".join(w), r.randint(0, 4)).replace("\n", ""))
    found = lines.line_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    home = {t: t for t in texts}
    for a in sorted(home):
        for b in sorted(home):
            if a < b and near(a, b) and home[a] != home[b]:
                x, y = home[a], home[b]
                home.update({t: x for t in home if home[t] == y})
    got = {}
    for x in found:
        got.setdefault(x["class_id"], set()).add(x["doc_id"])
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(home[t], set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert any(len({texts[i] for i in c}) > 1 for c in want.values())
    assert {x["doc_id"] for x in found if x["kept"]} == {min(c) for c in want.values()}


def test_shared_buckets_are_found_in_slices_of_twelve_bytes_a_key(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = ["\n".join(f"line {j * i % 40} of the text, {i % 3} for all and {j} for some" for j in range(30)) for i in range(12)] + [None, "", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    seen: dict[int, set[int]] = {}
    for name, who, key, _ in lines.line_entries(pa.array(texts)):
        for b, n in zip(key.tolist(), name[who].tolist()):
            seen.setdefault(b, set()).add(n)
    want = sorted((b, min(n)) for b, n in seen.items() if len(n) > 1)
    for most in (1, 1 << 20):
        monkeypatch.setattr(lines, "MOST_HELD", most)
        entries = lines._entries(rows, lines.EDITS, lines.PER)
        assert sorted(map(tuple, lines._shared(entries).collect())) == want and want
        sizes = entries.selectExpr("sum(length(keys)) k", "sum(length(nodes)) n").first()
        assert 8 * sizes["k"] == 4 * sizes["n"]
    assert lines._shared(lines._entries(rows.where("text is null"), lines.EDITS, lines.PER)).isEmpty()
    assert np.all([b % (1 << 64 - lines.KEY_BITS) == 0 for b in seen])


def test_buckets_of_the_same_lines_are_one(spark, monkeypatch):
    import pyarrow as pa

    texts = ["\n".join(f"the line number {j} has many words, of which {j * i % 4} is the last" for j in range(12)) for i in range(6)] + [None, "", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    seen: dict[int, set[int]] = {}
    for name, who, key, _ in lines.line_entries(pa.array(texts)):
        for b, n in zip(key.tolist(), name[who].tolist()):
            seen.setdefault(b, set()).add(n)
    want = {frozenset(x) for x in seen.values() if len(x) > 1}
    assert len(want) < sum(len(x) > 1 for x in seen.values())
    for most in (1, 1 << 20):
        monkeypatch.setattr(lines, "MOST_HELD", most)
        members, _, _ = lines._members(rows, lines.EDITS, lines.PER)
        got: dict[int, set[int]] = {}
        for x in members.collect():
            got.setdefault(x["bucket"], set()).add(x["node"])
            assert x["low"] == min(seen[x["bucket"]])
        assert len(got) == len(want) and {frozenset(x) for x in got.values()} == want
    assert lines._sets(lines._entries(rows.where("text is null"), lines.EDITS, lines.PER)).isEmpty()


@pytest.mark.parametrize("block", [1000, 5])
def test_only_lines_with_a_possible_partner_are_fetched(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    # All share their first half, so they are in the same buckets; the other halves have characters of their own, but for a few pairs.
    texts = ["a stretch of forty characters, for all: " + chr(0x100 + 2 * i) * 20 + chr(0x101 + 2 * i) * 20 for i in range(32)]
    texts += [t[:-1] + "#" for t in texts[3:30:10]]
    fetched, compared, inside = [], [], lines._inside
    real = lines.written

    def noted(df, name, *more):
        out = real(df, name, *more)
        if "line" in out.columns and name != "sharing" and "line_no" not in out.columns:
            fetched.append(out.count())
        return out

    def counted(mixed, *more):
        compared.append(mixed.select("node").distinct().count())
        return inside(mixed, *more)

    monkeypatch.setattr(lines, "written", noted)
    monkeypatch.setattr(lines, "_inside", counted)
    found = lines.line_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    home = {}
    for x in found:
        home.setdefault(x["class_id"], []).append(x["doc_id"])
    want = {i: [i] for i in range(32)}
    for k, i in enumerate(range(3, 30, 10)):
        want[i].append(32 + k)
    assert sorted(map(sorted, home.values())) == sorted(want.values())
    assert compared and max(compared) < len(texts) // 3
    assert fetched and max(fetched) < len(texts) // 3


def test_a_worker_forgets_what_other_steps_kept(spark):
    from chronofold.llm import common, grams

    grams.gram_store(3, 4, 10)
    common.drop_stores()
    assert grams.gram_store.cache_info().currsize == 0


def test_tallies_of_halves_leave_out_pairs_before_their_edits_are_counted(monkeypatch):
    import random

    from chronofold.llm import lines

    r = random.Random(4)
    for _ in range(3000):  # never more than twice the edits
        x = "".join(r.choice("abcé") for _ in range(r.randint(0, 14)))
        y = list(x)
        for _ in range(r.randint(0, 5)):
            at = r.randint(0, len(y))
            y[at : at + r.randint(0, 1)] = r.choice(["", "a", "b", "一"])
        y = "".join(y)
        assert lines._unlike([x], [y])[0] <= 2 * lines.edit_distance(x, y, 50)
    seen = []
    whole = lines._banded
    monkeypatch.setattr(lines, "_banded", lambda xs, *rest: seen.extend(xs) or whole(xs, *rest))
    words = ["a" * 30 + "b" * 30, "b" * 30 + "a" * 30]  # of the same characters, which was all that was looked at before
    near = "a" * 30 + "c" + "b" * 29
    found = lines.near_lines([words[0]] * 20 + [words[0]] * 20, [words[1]] * 20 + [near] * 20, 8, 20)
    assert found.tolist() == [False] * 20 + [True] * 20 and len(seen) == 20
    wide = [("".join(r.choice("ab\U0001f600￿") for _ in range(90))) for _ in range(40)]  # characters of more than 16 bits, and the fill of 16
    changed = [x[:20] + "￿" + x[20:50] + x[52:] for x in wide]
    for xs, ys in ((wide, changed), (changed, wide)):
        assert lines.near_lines(xs, ys, 8, 20).tolist() == [lines.edit_distance(x, y, 4) <= 4 for x, y in zip(xs, ys)]


@pytest.mark.parametrize("part", [4096, 2])
def test_members_come_once_with_the_keys_that_found_them(spark, monkeypatch, part):
    import pyarrow as pa

    monkeypatch.setattr(lines, "PART", part, raising=False)
    texts = ["\n".join(f"the line number {j} has many words, of which {j * i % 4} is the last" for j in range(12)) for i in range(6)] * 3 + [None, "", "alone, and like none of the others"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    seen: dict[int, set[int]] = {}
    for name, who, key, _ in lines.line_entries(pa.array(texts)):
        for b, n in zip(key.tolist(), name[who].tolist()):
            seen.setdefault(b, set()).add(n)
    members, sketches, sharing = lines._members(rows, lines.EDITS, lines.PER)
    found = members.collect()
    assert len({(x["bucket"], x["node"]) for x in found}) == len(found)  # lines that are in several tasks were there as often
    got: dict[int, set[int]] = {}
    for x in found:
        got.setdefault(x["bucket"], set()).add(x["node"])
        assert x["size"] == len(seen[x["bucket"]])
    assert got and all(seen[b] == n for b, n in got.items())
    assert "buckets" not in sharing.columns  # keys are made in the first pass only
    held = {x["node"] for x in found}
    assert {x["node"] for x in sketches.collect()} >= held
    assert all(len(x["line"]) == x["size"] and len(x["line"].encode()) == x["bytes"] and x["line_id"] == md5(x["line"].encode()).digest() for x in sharing.collect())


def test_lines_without_copies_or_near_ones_are_not_joined_again(spark, monkeypatch):
    near_ones = ["a line of some forty characters, number 1", "a line of some forty characters, number 2"]
    texts = [(5, "one\n\ntwo\none"), (None, "two\nthree \n \x01\xa0\t\n\xa0 four"), (None, near_ones[1]), (3, near_ones[0] + "\none"), (3, near_ones[1] + "\n\x7f\né five"), (1, None), (0, "")]
    totals, real = [], lines.written

    def noted(df, name, *more):
        out = real(df, name, *more)
        totals.extend(out.collect() if name == "totals" else [])
        return out

    monkeypatch.setattr(lines, "written", noted)
    found = lines.line_classes(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect()
    each = [(doc, at, n, x) for at, (doc, text) in enumerate(texts) for n, x in enumerate((text or "").split("\n")) if x.strip("".join(map(chr, range(33))) + "\xa0")]
    name = {x: md5(x.encode()).hexdigest() for *_, x in each}
    first = {}
    for doc, at, n, x in sorted(each, key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2])):
        first.setdefault(near_ones[0] if x in near_ones else x, (at, n, x))
    copies = Counter(x for *_, x in each)
    want = []
    for doc, at, n, x in each:
        to = first[near_ones[0] if x in near_ones else x]
        want.append((str(doc), n, name[x], name[to[2]], copies[x], to[:2] == (at, n)))
    assert sorted((str(x["doc_id"]), x["line_no"], x["line_id"], x["class_id"], x["copies"], x["kept"]) for x in found) == sorted(want)
    alone = {x["id"].hex() for x in totals if x["copies"] == 1 and x["class"] is None}
    assert alone == {name[x] for x in name if copies[x] == 1 and x not in near_ones} and len(alone) == 4
