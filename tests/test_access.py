"""What arguments name, against hand-made answers, and the bounds."""

import json

from pyspark.sql import functions as F

from plumbline.functions.canon import digest
from plumbline.operators import access
from plumbline.plans import access as plans


def found(spark, *arguments):
    rows = [(i, "t", a if a is None or isinstance(a, str) else json.dumps(a)) for i, a in enumerate(arguments)]
    df = spark.createDataFrame(rows, "id int, tool string, arguments string").withColumns({c: F.lit(1) for c in ("at", "key", "name", "kind", "leaves")})
    out = [[] for _ in rows]
    for r in access.accessed(df).orderBy("id", "place").collect():
        out[r.id].append((r.kind, r.name, r.digest))
    return out


def test_kinds(spark):
    got = found(
        spark,
        {"path": "notes", "x_dir": "d", "q": "plain", "list": ["~/a", "C:\\b", "\\\\srv\\c", "../d", ".e"], "Table": "t", "db": 5, "doc_id": True, "index": 1.5, "file": 7, "bucket": ""},
        {"a": {"files": [["one", {"deep": "/x"}], "two"]}},
        "not json", None, ["https://h.example/p", "s3://bucket/key?x", "a://x", "ftp://U:P@H.Example:21/f;x"],
        {"u": ["file://host/p", "file:///p", "http://[::1/bad?q", "http://h:99999/x"]},
        {"path": "same", "file": "same", "table": "same"},
    )
    assert [(k, n) for k, n, _ in got[0]] == [("file", "notes"), ("file", "d"), ("file", "~/a"), ("file", "C:\\b"), ("file", "\\\\srv\\c"), ("file", "../d"), ("record", "t"), ("record", "5")]
    assert got[0][0][2] == digest("notes") and got[0][-1][2] == digest(5)
    assert [n for _, n, _ in got[1]] == ["one", "/x", "two"]
    assert got[2] == got[3] == []
    assert [(k, n) for k, n, _ in got[4]] == [("url", "https://h.example/p"), ("url", "s3://bucket/key"), ("file", "a://x"), ("url", "ftp://h.example:21/f;x")]
    assert [(k, n) for k, n, _ in got[5]] == [("file", "host/p"), ("file", "/p"), ("url", "http://[::1/bad"), ("url", "http://h/x")]
    assert [(k, n) for k, n, _ in got[6]] == [("file", "same"), ("record", "same")]


def test_bounds(spark):
    deep = "/bottom"
    for _ in range(8):
        deep = {"k": deep}
    got = found(spark, deep, {"k": deep}, {"paths": [f"/{i}" for i in range(300)]}, {"path": "n" * 600}, {"path": ["n" * 600 + "a", "n" * 600 + "b"]}, "[" * 50000, {"path": "\ud800", "file": "ok"})
    assert got[0] and not got[1]
    assert [n for _, n, _ in got[2]] == [f"/{i}" for i in range(256)]
    assert got[3][0][1] == "n" * 509 + "..." and got[3][0][2] == digest("n" * 600)
    assert len(got[4]) == 2 and got[5] == [] and [n for _, n, _ in got[6]] == ["ok"]


def test_register(spark):
    rows = [(1, "a", '{"path": "/x"}'), (2, "b", '{"path": "/x", "again": "/x"}'), (3, None, None), (4, "a", "{}"), (5, "a", '["/x", "/y"]')]
    things, seen = access.register(spark.createDataFrame(rows, "id long, tool string, arguments string"))
    assert sorted((r.name, r.calls, r.tools, r.first) for r in things.collect()) == [("/x", 3, 2, 1), ("/y", 1, 1, 5)]
    assert tuple(seen.first()) == (5, 4, 1)
    empty = spark.createDataFrame([], "id long, tool string, arguments string")
    assert access.register(empty)[0].collect() == [] and tuple(access.register(empty)[1].first()) == (0, 0, 0)


def test_register_sums_in_hash_tables(spark):
    calls = spark.createDataFrame([(2, None, '{"path": "/x"}'), (1, "b", '{"path": "/x"}')], "id long, tool string, arguments string")
    things, _ = access.register(calls)
    assert "SortAggregate" not in things._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[2:] for r in things.collect()] == [("/x", 2, 1, 1)]


def test_coverage_only_reads(spark):
    assert tuple(access.register(spark.createDataFrame([(1, "a", '{"path": "/x"}'), (2, "a", "{")], "id long, tool string, arguments string"))[1].first()) == (2, 1, 1)
    assert access.readable(spark.createDataFrame([(1, "{}")], "id long, arguments string")).columns == ["readable"]


def test_calls_are_not_shuffled_to_be_named(spark):
    calls = spark.createDataFrame([(1, "a", '{"path": "/x", "again": "/x"}'), (2, "b", '{"doc_id": 5}')], "id long, tool string, arguments string")
    named = access.accessed(calls)
    assert "Exchange" not in named._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r.place, r.kind, r.name) for r in named.orderBy("id").collect()] == [(1, 1, "file", "/x"), (2, 1, "record", "5")]


def test_calls_of_one_file_go_to_all_cores(spark, tmp_path):
    orders = spark.range(1, 401, 1, 1).selectExpr("id AS o_orderkey", "'F' AS o_orderstatus", "'1-URGENT' AS o_orderpriority")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    for query, n in ((plans.ax_walk, 2650), (plans.ax_coverage, 1)):
        found = query(spark, str(tmp_path))
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == n
    assert plans.calls(spark, str(tmp_path)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_things_come_a_row_each_from_python(spark):
    """No nested lists are made or taken apart, and calls that name many things go out in pieces."""
    calls = spark.createDataFrame([(i, json.dumps({"paths": [f"/{j}" for j in range(256)]}) if i % 3 else None) for i in range(300)], "id long, arguments string")
    named = access.accessed(calls.coalesce(1))
    assert "Generate" not in named._jdf.queryExecution().executedPlan().toString()
    rows = named.groupBy("id").agg(F.count("*").alias("k"), F.sum("place").alias("p"), F.countDistinct("digest").alias("d")).collect()
    assert sorted(map(tuple, rows)) == [(i, 256, 256 * 257 // 2, 256) for i in range(300) if i % 3]
