"""The cumulative-link quality classifier on three grades, awkward tables and against plain formulas."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronofold.llm import quality, textvec


def test_registered():
    assert "op2_quality" in entry.queries()


def test_loss_has_its_derivatives():
    r = np.random.default_rng(1)
    z, y, cut = r.normal(size=20), np.arange(20) % 3, np.array([-0.4, 0.9])
    value, by_z, by_cut = quality._loss(z, y, cut)
    p = 1 / (1 + np.exp(cut - z[:, None]))
    assert value == pytest.approx(-np.log(np.choose(y, [1 - p[:, 0], p[:, 0] - p[:, 1], p[:, 1]])).sum())
    for i in range(20):
        step = np.eye(20)[i] * 1e-5
        assert by_z[i] == pytest.approx((quality._loss(z + step, y, cut)[0] - quality._loss(z - step, y, cut)[0]) / 2e-5, rel=1e-4)
    for i in range(2):
        step = np.eye(2)[i] * 1e-5
        assert by_cut[i] == pytest.approx((quality._loss(z, y, cut + step)[0] - quality._loss(z, y, cut - step)[0]) / 2e-5, rel=1e-4)


def test_long_texts_in_parts_have_the_features_of_the_whole(monkeypatch):
    r = random.Random(4)
    texts = pa.array([" ".join(r.choice(["Aa", "b!", "c1", "É"]) for _ in range(n)) for n in (3, 500, 1, 0, 200)])
    whole = [np.concatenate(x) for x in zip(*quality.features(texts, 12))]
    monkeypatch.setattr(textvec.parts, "__defaults__", (60,))
    parts = [np.concatenate(x) for x in zip(*quality.features(texts, 12))]
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_quality(spark):
    r = random.Random(1)
    words = [["junk", "spam!!", "BUY"], ["plain", "text", "words"], ["careful", "prose", "Indeed,"]]
    rows = [(i, " ".join(r.choice(words[i % 3] + ["the", "of", "and"]) for _ in range(20)), [1, 3, 7][i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "quality")
    model = quality.fit(docs, labels)
    assert model.grades == (1, 3, 7) and model.threshold[0] < model.threshold[1]
    odd = spark.createDataFrame([(None, "x"), (1000, None), (1000, ""), (1001, "x " * 5000)], "doc_id long, text string")
    got = quality.score(docs.unionByName(odd), model).toPandas()
    assert len(got) == 604 and got["expected_grade"].between(1, 7).all() and got["tail_prob"].between(0, 1).all()
    held = got[got["doc_id"].isin(range(600)) & got["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert held["doc_id"].map(lambda d: zlib.crc32(str(int(d)).encode()) % 3 == 1).all()
    assert (held["predicted"] == held["quality"]).mean() > 0.97
    assert ((held["tail_prob"] >= 0.5) == (held["quality"] == 7)).mean() > 0.97
    assert len(got[got["doc_id"] == 1000]) == 2 and got[got["doc_id"] == 1000]["tail_prob"].nunique() == 1
    better = quality.score(docs, model, good=3).toPandas()["tail_prob"].to_numpy()
    assert (better >= quality.score(docs, model).toPandas()["tail_prob"].to_numpy()).all()
    none = quality.score(docs, quality.fit(docs, labels.limit(0)))
    assert none.count() == 600 and none.where("predicted is not null").isEmpty()
    one = quality.score(docs, quality.fit(docs, labels.withColumn("quality", F.lit(5))))
    assert {(x["expected_grade"], x["tail_prob"], x["predicted"]) for x in one.collect()} == {(5.0, 1.0, 5)}
