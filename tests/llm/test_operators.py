"""Every operator on awkward tables, and against plain versions of its definition."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import decontaminate, html_text, knn, language, lines, near_duplicates, packing, repair, toxicity
from chronofold.llm.encode import crc, word_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Component long, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(30, 80))) for _ in range(25)]
    near = texts[0].split()
    near[10] = "changed"
    texts += [texts[0], texts[1], " ".join(near), "", None, "one", "one two", "one two", "First line of a text here\nsecond line of the text", "First line of a text here!\nOther words entirely, and more", "x " * 5000]
    rows = [(i, t, "en", "s", None, i, "n") for i, t in enumerate(texts)] + [(3, texts[5], "en", "s", 0, 0, "dup"), (None, texts[2], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark, docs):
    text = docs.where("doc_id = 4").first()["text"].split()
    return spark.createDataFrame([(1, " ".join(text[5:25]).upper(), 0), (2, "One", 1), (3, None, 2), (4, "", 3), (2, "never seen words", 4), (None, "x", 5)], "item_id long, text string, rid long")


def test_near_duplicates(docs, empty):
    found = near_duplicates.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    rows = docs.collect()

    def shingled(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()

    sets = [(r["doc_id"], shingled(r["text"])) for r in rows]
    home = {d: d for d, _ in sets if d is not None}

    def root(x):
        return x if home[x] == x else root(home[x])

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = root(a), root(b)
                home[max(x, y)] = min(x, y)
    for r in found:
        if r["doc_id"] is not None:
            assert r["component_id"] == root(r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"])
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in found) == sorted((d or -1, len(s)) for d, s in sets)
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_groups_of_near_copies_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    r = random.Random(3)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"n{r.randint(0, 10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 3]) for i in range(118)} for t in texts]
    label = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {x["doc_id"]: x["component_id"] for x in near_duplicates.near_duplicates(df).collect()} == dict(enumerate(label))


def test_decontamination(docs, items, empty):
    def check(found):
        got = {r["doc_id"]: r for r in decontaminate.judged(found).collect() if r["doc_id"] not in (3, None)}
        assert got[4]["n_hit"] == 20 and got[4]["n_items"] == 1 and got[4]["contaminated"]
        one = docs.where("text = 'one'").first()["doc_id"]
        assert (got[one]["n_words"], got[one]["n_hit"], got[one]["items_sha256"]) == (1, 1, "d4735e3a265e16eee03f59718b9b5d03019c07d8b6c51f90da3a666eec13ab35")
        assert not got[0]["contaminated"] and sum(r["n_words"] for r in got.values()) > 0

    check(decontaminate.find(docs, items))
    check(decontaminate.find(docs, items, most_words=5))
    assert decontaminate.find(empty, items).count() == 0
    assert {r["n_hit"] for r in decontaminate.judged(decontaminate.find(docs, empty.withColumnRenamed("doc_id", "item_id"))).collect()} == {0}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.where("doc_id = 4").isEmpty() and kept.where("doc_id = 0").count() == 1


def test_lines(docs, empty):
    found = lines.line_classes(docs).collect()
    texts = {(r["doc_id"], i): x for r in docs.where("doc_id > 3").collect() for i, x in enumerate((r["text"] or "").split("\n")) if x.strip()}
    got = {(r["doc_id"], r["line_no"]): r for r in found if r["doc_id"] is not None and r["doc_id"] > 3}
    assert got.keys() == texts.keys()
    first = next(k for k, v in texts.items() if v == "First line of a text here")
    second = next(k for k, v in texts.items() if v == "First line of a text here!")
    assert got[first]["class_id"] == got[second]["class_id"] and got[first]["kept"] and not got[second]["kept"]
    assert sum(r["kept"] for r in found) == len({r["class_id"] for r in found})
    cleaned = lines.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.where("doc_id = 25").isEmpty() and cleaned.where("text = ''").count() == 1
    assert lines.line_classes(empty).count() == 0 and lines.clean(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    pieces = packing.pack(docs).toPandas()
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"].to_numpy() == np.concatenate([[0], own["length"].cumsum()[:-1]])).all() and own["length"].sum() <= 4096
    for r in docs.where("doc_id > 3").collect():
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [2], np.uint32)
        own = pieces[pieces["doc_id"] == r["doc_id"]].sort_values("start")
        assert own["length"].sum() == len(ids) == own["doc_tokens"].iloc[0]
        assert [crc(ids[s : s + n]) for s, n in zip(own["start"], own["length"])] == own["ids_crc32"].tolist()
    assert packing.pack(empty).count() == 0


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    rows = docs.orderBy(F.col("doc_id").asc_nulls_first(), "text").collect()
    at, want = 0, []
    for r in rows:
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [1], np.uint32)
        want.append((r["doc_id"], at, len(ids), crc(ids)))
        at += len(ids)
    key = lambda x: x[1]
    assert sorted(map(tuple, repair.encode(docs).collect()), key=key) == want
    assert sorted(map(tuple, repair.encode(docs, block_ids=100).collect()), key=key) == want
    assert repair.encode(empty).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 16)
    r = np.random.default_rng(2)
    vectors = [r.normal(size=6).round(2).tolist() for _ in range(150)] + [[1.0] * 6] * 90 + [None, [], [float("nan")] * 6, [None] * 6, [float("inf")] * 6, [1.0]]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(None, [1.0] * 6, 0), (7, [1.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int")
    asked = df.where("vec_id % 10 = 0")
    found = {}
    for x in knn.top_k(df, asked).collect():
        found.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    good = [(i, np.floor(256 * np.array([*v, *[0.0] * (6 - len(v))]))) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in good:
        if q % 10 == 0:
            best = sorted((-int(v @ x), i) for i, x in good if i != q)[:5]
            assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert knn.top_k(df.limit(0), asked).count() == 0 and knn.top_k(df, asked.limit(0)).count() == 0


def labelled(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(900):
        w = [r.choice(words) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            w[r.randrange(40)] = r.choice(["zzyzx", "qwqwq"])
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_toxicity(spark, docs, empty):
    df, labels = labelled(spark)
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got["score"] >= 0.7) == (got["toxic"] == 1)).mean() > 0.97
    assert got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1).all()
    assert toxicity.clean(df, model).count() == pytest.approx(720, abs=30)
    odd = toxicity.score(docs, model).toPandas()
    assert len(odd) == docs.count() and odd["score"].between(0, 1).all()
    none = toxicity.fit(empty, labels.limit(0))
    assert toxicity.score(docs, none).count() == docs.count() and toxicity.score(empty, model).count() == 0


def test_language(spark, docs, empty):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["the", "and", "thing"] if i % 2 else ["der", "und", "ding"]) + r.choice("abc") for _ in range(30)), "en" if i % 2 else "de") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    got = language.predict(df, model).join(df.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).all() and got["score"].between(0, 1).all()
    odd = language.predict(docs, model)
    assert odd.count() == docs.count() and {x["lang_pred"] for x in odd.join(docs.where("text is null or text = ''").select("doc_id"), "doc_id").collect()} == {"und"}
    assert language.fit(empty) is None and language.predict(docs, None).where("lang_pred <> 'und'").isEmpty()


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", 1), (1, None, None, 2), (None, "u", "", 3), (2, "u", "<p>b<p>c", 4)], "page_id long, url string, html string, text long")
    assert [tuple(r) for r in html_text.extract(df).collect()] == [(1, "u", "a", 1), (1, None, "", 0), (None, "u", "", 0), (2, "u", "b\nc", 3)]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_components_in_one_task_and_in_many(spark, monkeypatch, few):
    from chronofold.llm import components

    monkeypatch.setattr(components, "FEW", few)
    r = random.Random(7)
    links = [(r.randrange(90), r.randrange(90)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(30)] + [(None, 3), (5, 5)]
    home = {}
    for a, b in links:
        if a is not None and a != b:
            x, y = home.setdefault(a, a), home.setdefault(b, b)
            home.update({k: min(x, y) for k, h in home.items() if h in (x, y)})
    df = spark.createDataFrame(links, "a long, b long")
    found = components.components(df)
    assert {r["node"]: r["component"] for r in found.collect()} == home
    more = spark.createDataFrame([(0, 200), (300, 301), (301, 230)], "a long, b long")
    whole = components.components(df.unionByName(more))
    assert sorted(map(tuple, components.extended(found, more).collect())) == sorted(map(tuple, whole.collect()))
    assert components.components(df.limit(0)).count() == 0


def test_grammar_leaves_no_frequent_pair():
    r = random.Random(2)
    phrases = [[r.randrange(50) for _ in range(r.randint(2, 30))] for _ in range(40)]
    ids = np.array([x for _ in range(700) for x in (*r.choice(phrases), *([7] * r.randint(0, 9)), *([99] if r.random() < 0.1 else []))], np.uint32)
    symbols, rules, lengths = repair.compress(ids, 100, 99)
    at, key = repair.frequent_pairs(symbols, None, 99, 8)
    assert np.unique(key, return_counts=True)[1].max(initial=0) < 8 and len(symbols) < len(ids) / 5
    assert np.array_equal(repair.expand(symbols, rules, lengths, 100), ids)
    for a, b in ((0, len(ids)), (5, 6), (1000, 1400), (len(ids) - 3, len(ids)), (10, 10)):
        assert np.array_equal(repair.expand_part(symbols, rules, lengths, 100, a, b), ids[a:b])
    for odd in ([], [1], [99] * 20, [3] * 1000):
        s, u, n = repair.compress(np.array(odd, np.uint32), 100, 99)
        assert np.array_equal(repair.expand(s, u, n, 100), odd)


def test_documents_are_fetched_by_id(spark, docs, tmp_path):
    path = str(tmp_path / "tokens")
    repair.write(docs, path, block_ids=50)
    want = {r["doc_id"]: r for r in repair.read(spark, path).collect()}
    for d in (4, 5, 25):
        (ids,) = repair.fetch(spark, path, d)
        assert len(ids) == want[d]["n_tokens"] and repair.crc(ids) == want[d]["ids_crc32"]
        (some,) = repair.fetch(spark, path, d, 2, 5)
        assert np.array_equal(some, ids[2:5])
    assert repair.fetch(spark, path, -12345) == []
    with pytest.raises(ValueError):
        repair.pack_block([1], [np.array([7, 500, 1], np.uint32)], 500, 1)


def test_bounds_leave_out_groups_of_clustered_data(spark):
    """Queries look at few groups where groups are apart, and results are those of all pairs."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 8)) * 40
    rows = [(i, (centres[i % 20] + r.normal(size=8)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0")
    valid = lambda t: knn._valid(t, "vec_id", "embedding", 256.0)
    groups = knn.groups(valid(df))
    assert knn.needed(valid(asked), groups, 5).count() < 0.5 * asked.count() * len(groups.cell)
    x = np.floor(256 * np.array([v for _, v in rows]))
    for q, found in knn.top_k(df, asked).toPandas().groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(1200), -score))[:5]
        assert found.sort_values("rank")["vec_id"].tolist() == best.tolist() and found.sort_values("rank")["score"].tolist() == score[best].tolist()
