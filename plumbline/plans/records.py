"""Queries on small records: authority, declarations, pins of heads, bound facts, results, command lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import records
from plumbline.plans import ledgers
from plumbline.session import settled, table


def rw_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), records.authority(F.col("c_name"), F.when(k % 3 == 0, "v2"), F.when(k % 2 == 0, F.col("c_mktsegment"))).alias("block"))


def rw_call_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", records.call_digest(F.col("event_type"), F.replace("props", F.lit(" "), F.lit(""))).alias("digest"))


def rw_declare(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ledgers.bodies(spark, sf_dir).withColumnRenamed("body", "raw").where("event_id % 59 = 0")
    return records.declare(lines, "known")


def wn_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(ledgers.chained(spark, sf_dir))
    return records.head_pins(rows.withColumn("body", F.when((F.col("ledger_id").cast("long") % 4 == 0) & (F.col("line") == 2), "x").otherwise(F.col("body"))))


def at_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_name").alias("value"))
    now = facts.where("name % 13 <> 0").withColumn("value", F.when(F.col("name") % 7 == 0, F.upper("value")).otherwise(F.col("value")))
    return records.recheck(records.bind(facts), now)


def tx_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), 1 + (k % 4).cast("int")), lambda i: i.cast("string")), ","), F.lit("]"))
    result = F.when(k % 5 == 0, listed).when(k % 5 == 1, F.concat(F.lit('{"items": '), listed, F.lit("}"))).when(k % 5 == 2, F.concat(F.lit('{"results":'), listed, F.lit("}"))).when(k % 5 == 3, "{}").otherwise("plain")
    return table(spark, sf_dir, "part").select(k.alias("id"), records.item_count(result).alias("items"))


def tx_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    command = F.concat(F.lit("run --name "), F.col("p_brand"), F.lit(" --api-key=k"), k, F.lit(" MY_TOKEN="), k, F.lit(" --password s"), k, F.lit(" --keep "), k)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), records.without_credentials(command).alias("command"))


def ax_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    arguments = F.concat(F.lit('{"path": "/data/'), k, F.lit('.csv", "from": ["https://a.example/x/'), F.col("p_size").cast("string"), F.lit('", "./b/c"], "again": "/data/'), k, F.lit('.csv"}'))
    return records.accessed(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), arguments.alias("arguments")))


QUERIES = {f.__name__: f for f in (rw_authority, rw_call_digest, rw_declare, wn_heads, at_recheck, tx_items, tx_redact, ax_access)}

# ---- SQL

ORACLE = {
    "rw_authority": """SELECT c_custkey AS id, '{"principal":"' || c_name || '"' || CASE WHEN c_custkey % 3 = 0 THEN ',"version":"v2"' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN ',"schema":"' || substr(sha256(c_mktsegment), 1, 16) || '"' ELSE '' END || '}' AS block FROM customer""",
    "rw_call_digest": """SELECT event_id, 'sha256:json-c14n:v1:' || sha256('{"arguments":' || replace(props, ' ', '') || ',"name":"' || event_type || '"}') AS digest FROM events""",
    "rw_declare": ledgers.BASE + "SELECT ledger_id, line AS orphan_line, sha256(body) AS raw_sha256, 'known' AS why FROM bodies WHERE event_id % 59 = 0",
    "wn_heads": ledgers.BASE + "SELECT ledger_id AS namespace, count(*) AS rows, last(chain ORDER BY line) AS chain FROM chained GROUP BY 1 HAVING NOT (CAST(ledger_id AS BIGINT) % 4 = 0 AND count(*) >= 2)",
    "at_recheck": "SELECT p_partkey AS name, CASE WHEN p_partkey % 13 = 0 THEN 'could_not_look' WHEN p_partkey % 7 = 0 AND upper(p_name) <> p_name THEN 'changed' ELSE 'same' END AS finding FROM part",
    "tx_items": "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 < 3 THEN p_partkey % 4 + 1 END AS items FROM part",
    "tx_redact": "SELECT p_partkey AS id, 'run --name ' || p_brand || ' --api-key=*** MY_TOKEN=*** --password *** --keep ' || p_partkey AS command FROM part",
    "ax_access": "SELECT p_partkey AS id, 'url' AS kind, 'https://a.example/x/' || p_size AS name FROM part UNION ALL SELECT p_partkey, 'file', '/data/' || p_partkey || '.csv' FROM part UNION ALL SELECT p_partkey, 'file', './b/c' FROM part",
}
