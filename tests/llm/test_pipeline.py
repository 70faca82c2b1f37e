"""The five stages against brute-force versions, row by row, each on its own input."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_lines import near

STAGES = dict(corpus_pipeline.STAGES)
#: Columns whose names the operators use themselves.
CLASHING = {"chronofold_rid": "'a'", "rid": "1L", "kept": "true", "node": "2L", "bucket": "'b'", "score": "0.5", "class_id": "'c'"}


def say(r, n, words):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """documents, labels and benchmark with something for every stage, as Parquet."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(900)]
    vile = ["vilest" + x for x in ("one", "two", "three")]
    item = say(r, 40, words)
    texts, kinds = [], []

    def add(kind, text):
        texts.append(text)
        kinds.append(kind)

    for i in range(90):
        add("clean", "\n".join(say(r, r.randint(9, 22), words) for _ in range(r.randint(1, 4))))
        if i % 3 == 0:
            add("toxic", "\n".join(say(r, 6, words) + " " + say(r, 6, vile) for _ in range(3)))
    shared, flowing = say(r, 15, words), [say(r, 120, words).split() for _ in range(3)]
    for i in range(6):
        add("line", say(r, 12, words) + "\n" + shared[:-2] + "xyz"[i % 3] * 2 + "\n" + say(r, 10, words))
        for w in flowing:  # the same words, broken into lines anew, so that only shingles are alike
            cut = 23 + 7 * i
            add("near", "\n".join(" ".join(w[a : a + cut]) for a in range(0, len(w), cut)))
        add("bench", say(r, 20, words) + " " + " ".join(item.split()[i : i + 20]) + " " + say(r, 8, words))
    for odd in (None, "", " \n\t\n", "x", "x", "é", "The end.", "The and."):
        add("odd", odd)
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows[2] = (None, *rows[2][1:])  # a clean one
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"{v} AS {k}" for k, v in CLASHING.items()))
    docs.repartition(3, "doc_id").write.parquet(str(path / "documents.parquet"))
    labels = [(i, int(k == "toxic")) for i, k in enumerate(kinds) if k in ("toxic", "clean")] + [(None, 1), (3, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(0, item), (1, None), (None, shared), (2, "")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), kinds


def components(n, links):
    home = list(range(n))
    for a, b in links:
        x, y = home[a], home[b]
        if x != y:
            home = [min(x, y) if h in (x, y) else h for h in home]
    return home


def without_repeated(rows):
    """Every line stays where its class is first; documents that lose all their lines go."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0))
    lines = [(i, n, x) for i in order for n, x in enumerate((rows[i]["text"] or "").split("\n")) if x.strip()]
    texts = sorted({x for _, _, x in lines})
    tally = [Counter(x) for x in texts]
    close = [(a, b) for a in range(len(texts)) for b in range(a) if abs(len(texts[a]) - len(texts[b])) <= 8 and sum((tally[a] - tally[b]).values()) <= 8 and near(texts[a], texts[b])]
    label = dict(zip(texts, components(len(texts), close)))
    seen, gone, had = set(), defaultdict(set), Counter()
    for i, n, x in lines:
        had[i] += 1
        if label[x] in seen:
            gone[i].add(n)
        seen.add(label[x])
    out = []
    for i, r in enumerate(rows):
        if not had[i] or len(gone[i]) < had[i]:
            text = r["text"] if not gone[i] else "\n".join(x for n, x in enumerate(r["text"].split("\n")) if n not in gone[i])
            out.append((r["doc_id"], text))
    return out


def without_near(rows):
    """One document of each component of 5-word shingle sets that are similar to 0.8; which one is checked by the caller."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower())
        n = min(len(w), 5)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    return components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])


def contaminated(text, items):
    w, hit = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()), set()
    for item in items:
        n = min(len(item), 13)
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if item else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def pairs(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_stages(spark, made, tmp_path):
    path, kinds = made
    assert list(STAGES) == ["toxicity", "line dedup", "minhash near-dedup", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = [(docs, docs.collect())]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1][0], path).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        steps.append((after, after.collect()))
        if i < 4:
            assert after.columns == docs.columns and len(steps[-1][1]) < len(steps[-2][1])
    before, clean, lined, apart, safe = (s[1] for s in steps[:5])
    assert pairs(clean) == pairs(r for r in before if r["doc_id"] is None or kinds[r["doc_id"]] != "toxic")
    assert pairs(lined) == Counter(without_repeated(clean))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in lined)
    home = without_near(lined)
    groups, left = defaultdict(list), pairs(apart)
    for r, h in zip(lined, home):
        groups[h].append((r["doc_id"], r["text"]))
    assert sum(left.values()) == len(groups) and all(sum(left[p] > 0 for p in set(g)) == 1 for g in groups.values())
    items = [re.findall(r"[a-z0-9]+", (r["text"] or "").lower()) for r in spark.read.parquet(f"{path}/benchmark.parquet").where("item_id is not null").collect()]
    assert pairs(safe) == pairs(r for r in apart if not contaminated(r["text"], items))
    # Pieces hold every id once, sequences are gapless and within their bound.
    pieces = steps[5][1]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append((p["start"], p["length"], p["doc_tokens"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert by_doc.keys() == {r["doc_id"] for r in safe}
    for runs in (*([x[:2] for x in v] for v in by_doc.values()), *by_sequence.values()):
        at = 0
        for start, length in sorted(runs):
            assert start == at
            at += length
    assert all(sum(n for _, n, _ in v) == v[0][2] for v in by_doc.values()) and all(sum(n for _, n in v) <= 4096 for v in by_sequence.values())
    assert corpus_pipeline.run(spark, path).count() == len(pieces)


def test_stages_may_be_chained_without_writing(spark, made):
    path, _ = made
    docs = spark.read.parquet(f"{path}/documents.parquet")
    chained = STAGES["minhash near-dedup"](spark, STAGES["line dedup"](spark, STAGES["toxicity"](spark, docs, path), path), path)
    assert 0 < chained.count() < docs.count()


def test_empty_table(spark, made):
    path, _ = made
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0, name


def test_columns_of_other_operators_stay(spark, made):
    path, _ = made
    docs = spark.read.parquet(f"{path}/documents.parquet").where(F.col("doc_id") < 3)
    for name in list(STAGES)[1:4]:
        row = STAGES[name](spark, docs, path).first().asDict()
        assert (row["chronofold_rid"], row["rid"], row["node"], row["bucket"], row["class_id"]) == ("a", 1, 2, "b", "c"), name


def test_tables_of_the_driver_need_no_python_workers(spark, made):
    from chronofold.llm.common import local_table

    path, _ = made
    plan = STAGES["packing"](spark, spark.read.parquet(f"{path}/documents.parquet"), path)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" in plan  # rows of Python objects were an RDD of Python workers
    assert [tuple(r) for r in local_table(spark, [(1, "a"), (2, None)], "x long, y string").collect()] == [(1, "a"), (2, None)]
    empty = local_table(spark, [], "x long, y string")
    assert empty.count() == 0 and empty.columns == ["x", "y"]
