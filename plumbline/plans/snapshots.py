"""Queries on sealed snapshots of what customers declare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import snapshots
from plumbline.session import settled, table


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot a customer of what it has ordered at which priorities."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"), F.count("*").alias("orders"))
    manifest = F.to_json(F.struct("priorities", "orders"))
    return snapshots.sealed(o.select("id", F.col("id").cast("string").alias("label"), manifest.alias("manifest")), "2026-01-01T00:00:00Z")


def ct_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probes of each snapshot."""
    return snapshots.probes(settled(made(spark, sf_dir).select("id", "raw")))


def ct_seal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots altered in one way or another."""
    k = F.col("id") % 6
    raw = (
        F.when(k == 1, F.regexp_replace("raw", '"orders":', '"orders":1'))
        .when(k == 2, F.regexp_replace("raw", "State orders", "Name orders"))
        .when(k == 3, F.regexp_replace("raw", '"label":"', '"label":"x'))
        .when(k == 4, F.expr("substring(raw, 1, 60)"))
        .otherwise(F.col("raw"))
    )
    return snapshots.check(made(spark, sf_dir).select("id", raw.alias("raw")))


QUERIES = {f.__name__: f for f in (ct_sealed, ct_seal_check)}

ORACLE = {
    "ct_sealed": """SELECT DISTINCT o_custkey AS id, 'priorities:' || substr(sha256('"' || o_orderpriority || '"'), 1, 12) AS probe, o_orderpriority AS answer FROM orders UNION ALL
SELECT o_custkey, 'orders:' || substr(sha256(CAST(count(*) AS VARCHAR)), 1, 12), CAST(count(*) AS VARCHAR) FROM orders GROUP BY 1""",
    "ct_seal_check": "SELECT DISTINCT o_custkey AS id, CASE o_custkey % 6 WHEN 1 THEN 'manifest_altered' WHEN 2 THEN 'probes_altered' WHEN 3 THEN 'seal_altered' WHEN 4 THEN 'unreadable' ELSE 'good' END AS state FROM orders",
}
