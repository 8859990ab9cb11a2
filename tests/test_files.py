"""Ledger files, exact line numbers, and streams."""

import hashlib
import json

from pyspark.sql import functions as F

from plumbline.operators import rows
from plumbline.sources import ledger
from plumbline.streaming import claims


def link(previous, row):
    return hashlib.sha256((previous + json.dumps(row, sort_keys=True, ensure_ascii=False)).encode()).hexdigest()[:32]


def test_a_file_of_rows(spark, tmp_path):
    bodies = [{"z": 1, "a": "é "}, {"n": [1, {"k": None}]}, {}, {"t": "x" * 40000}]
    lines, previous = [], "genesis"
    for b in bodies:
        previous = link(previous, b)
        lines.append(json.dumps({"chain": previous, **b}, ensure_ascii=False))
    odd = ["", '{"a": 1, "a": 2}', "[1]", '{"torn": ', "[" * 3000, '{"a": "\\ud800"}', '{"chain": 5, "b": 1}']
    (tmp_path / "one.jsonl").write_text("\n".join(lines + odd) + "\n", encoding="utf-8", newline="")
    (tmp_path / "empty.jsonl").write_text("")
    read = ledger.read_ledger(spark, str(tmp_path / "*.jsonl")).orderBy("line").collect()
    assert [r.state for r in read] == ["row"] * 4 + ["blank", "unreadable", "no_object", "unreadable", "unreadable", "unreadable", "row"]
    assert [r.line for r in read] == list(range(1, 12)) and [r.raw for r in read] == lines + odd
    found = rows.verify_lines(ledger.read_lines(spark, str(tmp_path / "one.jsonl"))).first()
    assert (found.rows, found.chained, found.breaks, found.first_break, found.unreadable, found.ok) == (5, 4, 1, 11, 5, False)


def test_appended_lines_verify(spark):
    made = rows.append(spark.createDataFrame([("a", i, "{}" if i == 2 else f'{{"n": {i}}}') for i in range(1, 5)], "ledger_id string, line long, body string"))
    assert rows.verify_lines(made).first().ok is True


def test_streams(spark, tmp_path):
    for i, batch in enumerate(([("a", "2026-01-01 00:00:00"), ("b", "2026-01-01 00:10:00")], [("a", "2026-01-01 00:20:00"), ("c", "2026-01-01 05:00:00")], [("d", "2026-01-01 09:00:00")])):
        spark.createDataFrame(batch, "key string, ts string").coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    for name, made in (("first", claims.first_claims(stream)), ("counts", claims.windowed_counts(stream.withColumn("event", F.lit("e"))))):
        q = made.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(r.key for r in spark.table("first").collect()) == ["a", "b", "c", "d"]
    assert [r.n for r in spark.table("counts").orderBy("start").collect()][0] == 3
