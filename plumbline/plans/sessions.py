"""Queries on recorded sessions: what a recorder may have written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import sessions
from plumbline.session import table


def tape_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tape a user: the events are calls, of which some are missing, invalid, answered, closed or open; sessions end at the last call, half way or not at all."""
    e = table(spark, sf_dir, "events")
    id_, user = F.col("event_id"), F.col("user_id")
    numbered = e.select(
        user.cast("string").alias("tape"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("idx"), F.col("ts").cast("timestamp").alias("at"), "event_id", "user_id", "event_type", "props"
    )
    none = F.lit(None).cast("string")

    def rows(kind: str, **more) -> DataFrame:
        return numbered.select("tape", F.lit(kind).alias("kind"), "idx", "at", *[more.get(c, none).alias(c) for c in ("tool", "req", "resp", "status", "reason")], "event_id", "user_id")

    calls = rows("call", tool=F.col("event_type"), req=F.md5(id_.cast("string")), status=F.when(id_ % 29 == 0, "invalid_id")).where("event_id % 53 <> 0")
    answers = rows("answer", resp=F.md5("props"), status=F.when(id_ % 4 == 0, "error").otherwise("ok")).where("event_id % 7 > 1")
    closes = rows("close", reason=F.lit("gone")).where("event_id % 7 = 1")
    ends = numbered.where("user_id % 3 < 2").groupBy("tape", "user_id").agg(F.max("idx").alias("n"))
    ends = ends.select("tape", F.lit("end").alias("kind"), F.floor(F.col("n") / (1 + user % 3)).alias("idx"), F.lit(None).cast("timestamp").alias("at"), *[none.alias(c) for c in ("tool", "req", "resp", "status", "reason")])
    return calls.unionAll(answers).unionAll(closes).drop("event_id", "user_id").unionAll(ends)


def sm_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.committed(tape_events(spark, sf_dir))


def sm_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that went out unanswered, by tape and reason."""
    return sm_commit(spark, sf_dir).where("status = 'unanswered'").groupBy("tape", "reason").agg(F.count("*").alias("n"), F.min("idx").alias("first"))


QUERIES = {f.__name__: f for f in (sm_commit, sm_open)}

# ---- SQL

COMMITTED = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, count(*) OVER (PARTITION BY user_id) AS total FROM events),
s AS (SELECT *, event_id % 53 <> 0 AS called, event_id % 29 = 0 AS bad, event_id % 7 > 1 AS answered, event_id % 7 = 1 AS closed, CASE user_id % 3 WHEN 0 THEN total WHEN 1 THEN total // 2 ELSE 0 END AS ended FROM n),
b AS (SELECT *, min(CASE WHEN idx > ended AND NOT (called AND (bad OR answered OR closed)) THEN idx END) OVER (PARTITION BY user_id) AS blocked FROM s),
committed AS (SELECT CAST(user_id AS VARCHAR) AS tape, idx, event_type AS tool, md5(CAST(event_id AS VARCHAR)) AS req, CASE WHEN NOT bad AND answered THEN md5(props) END AS resp,
  CASE WHEN bad THEN 'invalid_id' WHEN NOT answered THEN 'unanswered' WHEN event_id % 4 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN bad OR answered THEN NULL WHEN closed THEN 'gone' ELSE 'no_response' END AS reason FROM b WHERE called AND (idx <= ended OR idx < coalesce(blocked, idx + 1)))"""

ORACLE = {
    "sm_commit": f"{COMMITTED} SELECT * FROM committed",
    "sm_open": f"{COMMITTED} SELECT tape, reason, count(*) AS n, min(idx) AS first FROM committed WHERE status = 'unanswered' GROUP BY 1, 2",
}
