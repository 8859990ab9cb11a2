"""The pipeline's stages on their own inputs and as a whole."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline as P
from plumbline.llm import decontaminate, simhash
from test_simhash import plain


def test_keep_first_keeps_one_of_each_group(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in plain(rows)})


def test_keep_first_odd_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])
    rows = [(5, "one two three four", "a"), (5, "one two three four", "b"), (None, "one two three four", "c"), (7, None, "d"), (6, "", "e"), (None, "other words here now", "f"), (None, "other words here now", "g")]
    kept = simhash.keep_first(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == [(5, "one two three four"), (6, ""), (None, "other words here now")]
    assert simhash.keep_first(spark.createDataFrame([], schema)).collect() == []


def test_stages_one_by_one(spark):
    d = "/root/testdata/sf0.01"
    first = docs = spark.read.parquet(f"{d}/documents.parquet")
    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = P.materialize(stage(spark, docs, d))
        assert docs.columns == first.columns, name
        assert docs.exceptAll(before).count() == 0, name
        counts.append(docs.count())
    assert counts[1] >= 0.97 * counts[0] and 0.8 * counts[1] < counts[2] < counts[1] and counts[3] < counts[2] and counts[4] < counts[3]
    assert decontaminate.find(docs, spark.read.parquet(f"{d}/benchmark.parquet")).count() == 0
    packed = P.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n != end or n > 1024").count() == 0


def test_run_on_odd_tables(spark, tmp_path):
    """The whole pipeline on null ids and texts, repeated rows, an extra column, and on empty tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("labels", "benchmark"))
    odd = docs.limit(60).unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    odd = odd.withColumn("row_0", F.lit("x")).withColumn("n_0", F.lit(1)).withColumn("place_0", F.lit(1))
    for name, d in (("odd", odd), ("empty", odd.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        rows = P.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(rows) > 20) == (name == "odd") and all(r.length <= 1024 for r in rows)
