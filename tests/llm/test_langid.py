"""Language identification: gradients, held-out accuracy, odd rows."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import langid

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])


def test_gradients_match_differences():
    model = langid.fit([(b"abcde", "x"), (b"fgh", "y"), (b"zz", "z")], hidden=3, window=6, epochs=1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    rng = np.random.default_rng(1)
    x, valid, y = rng.integers(0, 255, (6, 3)), np.ones((6, 3), bool), np.array([0, 1, 2])
    valid[3:, 1] = False
    _, grads = langid.gradients(model, x, valid, y)
    for name, g in grads.items():
        i, w, e = np.unravel_index(np.abs(g).argmax(), g.shape), model.weights[name], 1e-3
        held = w[i]
        w[i] = held + e
        up = langid.gradients(model, x, valid, y)[0]
        w[i] = held - e
        down = langid.gradients(model, x, valid, y)[0]
        w[i] = held
        assert abs((up - down) / (2 * e) - g[i]) < 0.02 * abs(g[i]) + 1e-3, name


def test_every_byte_counts_once():
    model = langid.fit([(b"abcabcabc", "x"), (b"xyzxyz", "y")], hidden=4, window=8, epochs=2)
    texts = [b"", b"abc", b"abcxyzabcxyzq" * 9]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    got = langid.document_probabilities(model, raw, starts, lengths, windows=3)
    for i, t in enumerate(texts):
        want = np.zeros(2)
        for k in range(0, len(t), 8):
            w = np.frombuffer(t[k : k + 8], np.uint8).astype(np.intp)[:, None]
            want += langid.window_probabilities(model, w, np.ones(w.shape, bool))[:, 0]
        assert np.allclose(got[i], want / max(1, len(t)), atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert got[0] > 0.97 and got[1] > 150


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    words = [["der", "die", "das", "und", "nicht", "ich"], ["the", "and", "of", "that", "with", "is"]]
    base = [(i, " ".join(rng.choice(words[i % 2], 30)), ("de", "en")[i % 2], "clash") for i in range(400)]
    odd = [(None, "the and of", None, None), (100, None, "en", ""), (101, "", "de", ""), (102, "123 !!", "en", ""), (103, "the and " * 50000, None, ""), (103, "the and " * 50000, None, "")]
    rows = langid.predict(spark.createDataFrame(base + odd, SCHEMA)).collect()
    assert len(rows) == 406 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert [by[k].lang_pred for k in (100, 101, 102, 103, 5, 6)] == ["und", "und", "und", "en", "en", "de"]
    assert by[None].held_out
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.predict(empty).collect() == []
    assert {r.lang_pred for r in langid.predict(spark.createDataFrame(odd, SCHEMA).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_stage_keeps_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = langid.keep_identified(docs, langid.learn(docs, epochs=4))
    assert kept.columns == docs.columns and kept.count() >= 0.95 * docs.count()
