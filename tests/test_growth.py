"""Long texts and large keys: what a row costs grows with its own size, and keys stay whole."""

import math
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import canon, textual
from plumbline.functions.fold import column_fold
from plumbline.operators import distill, lookups, near, packs
from plumbline.plans import comparisons

LONG = " ".join(f"w{i * 7919 % 5003}x{i}" for i in range(12_000))


def test_overlap_of_long_texts(spark):
    pairs = [(0, LONG, LONG + " end"), (1, LONG[:5], LONG[:4]), (2, "a b", "a b c"), (3, "é😀ab c", "é😀ab d"), (4, "", "a")]
    began = time.monotonic()
    found = dict(map(tuple, spark.createDataFrame(pairs, "id int, x string, y string").select("id", textual.overlap(F.col("x"), F.col("y"))).collect()))
    assert time.monotonic() - began < 30
    for i, x, y in pairs[:4]:
        assert abs(found[i] - min(0.9995, *map(near._jaccard, near._sets(x), near._sets(y)))) < 1e-12
    assert found[4] == 0


def test_distilled_long_texts(spark):
    text = " ".join(f"Number {i} of 7 is said here." for i in range(6000))
    began = time.monotonic()
    row = distill.distill(spark.createDataFrame([(1, text)], "id int, text string"), 200, "the of 7").select("strategy", "receipt.drops", distill.receipt_state(F.to_json("receipt")).alias("state")).first()
    assert time.monotonic() - began < 30
    assert (row["strategy"], row["state"], len(row["drops"])) == ("text", "consistent", 1)


def test_sentences_chosen_from_long_texts(spark):
    parts = [f"Sentence number {i}." for i in range(6000)]
    began = time.monotonic()
    c = spark.createDataFrame([(" ".join(parts),)], "text string").select(distill.prose_cut(F.col("text"), 50).alias("c")).first()["c"]
    assert time.monotonic() - began < 30
    assert c["content"] == f"{parts[0]} [...] {parts[-1]}"
    assert c["drops"][0]["dropped_count"] == 5998


def test_folds_deal_keys_themselves_behind_joins(spark):
    plain = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(plain)
    spark.conf.set(plain, "-1")  # as large tables are planned; a join's partitions may be split while it runs
    try:
        rows, few = spark.range(0, 400, 1, 4).select((F.col("id") % 40).alias("k"), F.col("id").alias("n")), spark.range(40).select(F.col("id").alias("k"))
        made = column_fold(rows.join(few, "k", "left"), ["k"], ["n"], ["n"], lambda: 0, lambda s, n: (s + 1, (s + 1,)), T.StructType([T.StructField("place", T.LongType())]))
        assert "REPARTITION_BY_COL" in made._jdf.queryExecution().executedPlan().toString()
        assert made.groupBy("k").agg(F.max("place").alias("most")).where("most <> 10").count() == 0
    finally:
        spark.conf.set(plain, before)


def test_parts_beyond_a_million_are_still_added(spark, tmp_path):
    spark.range(1_000_000, 1_000_060).unionAll(spark.range(60)).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_type")).write.parquet(f"{tmp_path}/part.parquet")
    found = comparisons.ct_diff(spark, str(tmp_path))
    want = [(k, "removed" if k % 19 == 0 else "changed") for k in (*range(60), *range(1_000_000, 1_000_060)) if k % 19 == 0 or k % 23 == 0]
    want += [(k + 1_000_000, "added") for k in (*range(60), *range(1_000_000, 1_000_060)) if k % 29 == 0]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_entropy_within_each_key(spark):
    texts = {1: ["abca"], 2: [""], 3: ["aaaa"], 4: ["ab", "bc", "abc"], 5: ["é😀é"], 6: [None]}
    found = textual.entropy(spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts], "k int, t string"), "k", "t")
    want = {1: 1.5, 2: 0.0, 3: 0.0, 5: 0.918296, 6: 0.0}
    shares = [1 / 2, 2 / 2, 1 / 2, 1 / 3, 1 / 3, 1 / 3]
    want[4] = round(-sum(s * math.log2(s) for s in shares), 6)
    assert dict(map(tuple, found.collect())) == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no row a character


def test_packs_are_read_once(spark):
    raw = '{"event": "view", "ts": "2024-01-02", "chain": "c"}'
    source = spark.createDataFrame([("a", 1, raw), ("a", 2, "torn")], "ledger_id string, line long, raw string")
    made = packs.build(source, source.select("ledger_id", F.col("line").alias("rows"), F.lit("c").alias("chain")), "2024-01-01", "2024-01-03", ["view"])
    assert "MapInArrow" not in made["manifest"]._jdf.queryExecution().executedPlan().toString()
    assert {(r.section, r.field): r.value for r in made["fields"].collect() if r.section != "export"} == {("mandate", "allowed"): "1", ("mandate", "denied"): "0", ("mandate", "undecided"): "1", ("statements", "unreadable"): "1"}


def test_canonical_text_in_one_go(monkeypatch):
    row = {"b": [1, None, True, "\u00e9\n\u2028"], "a": {"z": "\U0001f600", "k": -(2**53)}}
    slow = {"\ue000": 1, "\U0001f600": 2, "x": 1.0}
    assert canon.jcs(slow) == '{"x":1,"\U0001f600":2,"\ue000":1}'
    for bad in (2**53 + 1, ["\ud800"], {"\ud800": 1}, float("nan")):
        with pytest.raises(ValueError):
            canon.jcs(bad)
    monkeypatch.setattr(canon, "_string", None)  # nothing is put together piece by piece
    assert canon.jcs(row) == '{"a":{"k":-9007199254740992,"z":"\U0001f600"},"b":[1,null,true,"\u00e9\\n\u2028"]}'


def test_citations_of_long_texts(spark):
    text = "\n".join(f"Citation{i % 10} x" for i in range(6000)).translate(str.maketrans("0123456789", "abcdefghij"))
    began = time.monotonic()
    found = lookups.look_up(spark.createDataFrame([(1, text)], "key long, text string"), spark.createDataFrame([], "cite string, attempt int, status string"), "[A-Z][a-z]{6,}", per_request=10**6).collect()
    assert time.monotonic() - began < 40
    assert len(found) == 6000 and all(text[r.start : r.stop] == r.cite and r.status == "not_found" for r in found)
