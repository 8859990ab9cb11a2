"""Toxicity: held-out separation, the label model's arithmetic, odd rows."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import toxicity

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def test_moments_recover_rates_and_correlation():
    rng = np.random.default_rng(5)
    y = rng.random(20000) < 0.3
    a = np.where(y, rng.random(20000) < 0.7, rng.random(20000) < 0.05)
    c = np.where(y, rng.random(20000) < 0.5, rng.random(20000) < 0.1)
    votes = np.stack([a, a, c], 1).astype(float)
    fires, shares, rho = toxicity.maximize(toxicity.moments(votes, np.ones(len(y)), y.astype(float)), 3)
    assert np.allclose(fires[1], [0.7, 0.7, 0.5], atol=0.02) and np.allclose(fires[0], [0.05, 0.05, 0.1], atol=0.02)
    assert rho[0, 1] > 0.99 and abs(rho[0, 2]) < 0.05 and shares[0] < 0.55 < 0.9 < shares[2]


def test_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.predict(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p"), F.count("*").alias("n")).collect()
    share = {r["toxic"]: r["p"] for r in rows}
    assert share[0] < 0.01 and share[1] > 0.8


def test_many_voters_stand_without_labels():
    assert toxicity.FIXED >= 30 and toxicity.MAX_VOTERS <= 63
    votes = toxicity.Voters([])
    low = "you are such an idiot! halt die klappe"
    mask = votes.votes(low, low, toxicity.terms_of(low))
    assert bin(mask).count("1") >= 4 and votes.votes("fine words", "fine words", {"fine", "words"}) == 0


def test_what_the_label_model_adds(spark):
    """Ablation: two voters that repeat one weak sign outvote a good voter by count, but not in the label model."""
    rng = np.random.default_rng(8)
    y = rng.random(30000) < 0.3
    weak = np.where(rng.random(len(y)) < 0.75, y, ~y)
    good = np.where(rng.random(len(y)) < 0.97, y, ~y)
    votes = np.stack([weak, weak, good], 1).astype(float)
    known = slice(0, 300)  # few labels; the rest of the rows have none
    fixed = toxicity.moments(votes[known], np.full(300, 10.0), y[known].astype(float))
    fires, shares, _ = toxicity.maximize(fixed, 3)
    ones = np.ones(300)
    scale = toxicity.calibrate(votes[known], y[known].astype(float), ones, fires, shares)
    for _ in range(6):
        p = toxicity.posterior(votes, scale, fires, shares)
        fires, shares, _ = toxicity.maximize(fixed + toxicity.moments(votes, np.ones(len(y)), p), 3)
        scale = toxicity.calibrate(votes[known], y[known].astype(float), ones, fires, shares)
    right = ((toxicity.posterior(votes, scale, fires, shares) > 0.5) == y).mean()
    by_count = ((votes.sum(1) > 1) == y).mean()
    assert right > 0.95 and by_count < 0.9


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    words = [f"plain{i}" for i in range(50)]
    base = [(i, " ".join(rng.choice(words, 20)) + (" zorgblat" if i % 4 == 0 else ""), "clash") for i in range(400)]
    odd = [(None, "zorgblat", None), (500, None, ""), (501, "", ""), (502, "zorgblat " * 100000, ""), (7, base[7][1], "clash")]
    docs = spark.createDataFrame(base + odd, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(3, 1, None), (None, 1, 1), (8, 0, 7), (12, 1, 1)], LABELS)
    rows = toxicity.predict(docs, labels).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 405 and all(0 <= r.score <= 1 for r in rows) and by[500].score == by[501].score < 0.5
    assert by[502].predicted == 1 and by[None].held_out
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in rows if r.doc_id is not None and r.doc_id < 400]) == 1
    none = toxicity.predict(spark.createDataFrame([(1, "you are an idiot", ""), (2, "fine words", "")], DOCS), labels.limit(0)).collect()
    assert {r.doc_id: r.predicted for r in none} == {1: 1, 2: 0}
    assert toxicity.predict(docs.limit(0), labels).collect() == []
