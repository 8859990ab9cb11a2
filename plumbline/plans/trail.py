"""Queries on ledgers exported as audit trails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import trail
from plumbline.plans.packs import ledgers
from plumbline.session import settled, table


def seam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seam log a customer's orders: calls, decisions and others; some lines are none."""
    o = table(spark, sf_dir, "orders")
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    kind = F.when(k % 3 == 0, '"evt":"tool_call","tool":"t"').when(k % 3 == 1, '"event":"decision"').otherwise('"evt":"note"')
    status = F.when(k % 4 == 0, ',"status":"ok"').when(k % 4 == 1, ',"status":"error"').otherwise("")
    seq = F.when(k % 13 == 0, ',"seq":9007199254740993').otherwise(F.concat(F.lit(',"seq":'), text))
    row = F.concat(F.lit('{"ts":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('",'), kind, status, seq, F.lit(',"agent":"'), F.col("o_orderstatus"), F.lit('"}'))
    return o.select(F.col("o_custkey").cast("string").alias("ledger_id"), k.alias("line"), F.when(k % 17 == 0, "[0]").otherwise(row).alias("raw"))


def ex_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail.exported(trail.records(seam_lines(spark, sf_dir)))


def ex_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail.gaps(settled(trail.records(seam_lines(spark, sf_dir))))


def ex_trail_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trails of the events' ledgers, some lines of which were lost or rewritten since."""
    made = trail.exported(trail.records(ledgers(spark, sf_dir)))
    k = F.col("ledger_id").cast("long")
    kept = made.where(~((k % 4 == 1) & (F.col("line") == 5)))
    numbered = kept.withColumn("n", F.row_number().over(Window.partitionBy("ledger_id").orderBy("line")))
    changed = F.when((k % 4 == 2) & (F.col("n") == 3), F.replace("raw", F.lit(":"), F.lit(": "))).when((k % 4 == 3) & (F.col("n") == 2), "[]").otherwise(F.col("raw"))
    return trail.verified(numbered.select("ledger_id", "n", changed.alias("raw")))


QUERIES = {f.__name__: f for f in (ex_trail, ex_gaps, ex_trail_verify)}

# ---- SQL

SEAM = """WITH RECURSIVE o AS (SELECT CAST(o_custkey AS VARCHAR) AS ledger_id, o_orderkey AS line, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS s, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 17 <> 0),
r AS (SELECT *, '{' || CASE WHEN k % 3 = 0 THEN '"action_detail":{"tool_name":"t"},' ELSE '' END || CASE k % 3 WHEN 0 THEN '"action_type":"tool_call",' WHEN 1 THEN '"action_type":"decision",' ELSE '' END || '"agent_id":"urn:agent:' || s || '"' || CASE k % 4 WHEN 0 THEN ',"outcome":"success"' WHEN 1 THEN ',"outcome":"failure"' ELSE '' END AS head,
  CASE WHEN k % 13 = 0 THEN '' ELSE ',"sequence_number":' || k END || ',"source_line":' || k || ',"timestamp":"' || day || '"}' AS tail, row_number() OVER (PARTITION BY ledger_id ORDER BY line) AS m FROM o)"""

ORACLE = {
    "ex_trail": SEAM + """, c AS (SELECT ledger_id, line, m, head || ',"prev_hash":null' || tail AS raw FROM r WHERE m = 1 UNION ALL SELECT r.ledger_id, r.line, r.m, r.head || ',"prev_hash":"' || sha256(c.raw) || '"' || r.tail FROM c JOIN r ON r.ledger_id = c.ledger_id AND r.m = c.m + 1) SELECT ledger_id, line, raw FROM c""",
    "ex_gaps": """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS ledger_id, o_orderkey AS k FROM orders),
g AS (SELECT ledger_id, k, unnest(['session_id', 'response_hash', 'input_hash', 'output_hash', 'recording_component', CASE WHEN k % 3 <> 0 THEN 'action_detail' END, CASE WHEN k % 3 = 2 THEN 'action_type' END, CASE WHEN k % 4 > 1 THEN 'outcome' END]) AS field, 'not_held' AS why FROM o WHERE k % 17 <> 0)
SELECT ledger_id, field, why, count(*) AS n, min(k) AS first FROM g WHERE field IS NOT NULL GROUP BY 1, 2, 3 UNION ALL
SELECT ledger_id, 'sequence_number', 'not_exact', count(*), min(k) FROM o WHERE k % 17 <> 0 AND k % 13 = 0 GROUP BY 1 UNION ALL SELECT ledger_id, NULL, 'no_object', count(*), min(k) FROM o WHERE k % 17 = 0 GROUP BY 1""",
    "ex_trail_verify": """WITH l AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line FROM events), k AS (SELECT * FROM l WHERE NOT (u % 5 = 4 AND line % 9 = 3)),
n AS (SELECT u, line, row_number() OVER (PARTITION BY u ORDER BY line) AS n FROM k WHERE NOT (u % 4 = 1 AND line = 5)),
g AS (SELECT u, count(*) AS records, max(n) AS last, max(CASE WHEN line < 5 THEN n END) AS before FROM n GROUP BY 1),
b AS (SELECT *, CASE WHEN u % 4 = 1 AND last > coalesce(before, 0) AND exists(SELECT 1 FROM k WHERE k.u = g.u AND line = 5) THEN coalesce(before, 0) + 1 WHEN u % 4 = 2 AND last >= 3 THEN 3 WHEN u % 4 = 3 AND last >= 2 THEN 2 END AS first_bad FROM g)
SELECT CAST(u AS VARCHAR) AS ledger_id, records, first_bad, CASE WHEN first_bad IS NOT NULL THEN CASE u % 4 WHEN 1 THEN 'broken' WHEN 2 THEN 'not_canonical' ELSE 'not_object' END END AS finding FROM b""",
}
