"""Queries on what calls name in their arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.canon import JSON_RECIPE
from plumbline.operators import access
from plumbline.session import table


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call an order: nested arguments with paths, URLs, records, repeats, and some that can't be read.

    Orders are small and what is done to each is not, so they are dealt to all
    cores, however the table's files and row groups are cut.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    o = o.repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    inner = F.struct(F.concat(F.lit("https://u:p@Host.example:8"), (k % 10).cast("string"), F.lit("/a/"), (k % 7).cast("string"), F.lit("?q=1#f")).alias("from"), F.array(F.concat(F.lit("./x/"), (k % 9).cast("string")), F.lit("plain")).alias("Files"), (k % 6).alias("doc_id"))
    body = F.to_json(F.struct(F.concat(F.lit("/data/"), (k % 50).cast("string")).alias("anything"), inner.alias("options"), F.col("o_orderpriority").alias("table"), F.lit("./x/1").alias("again"), F.lit(True).alias("record"), F.lit("file:///etc/hosts").alias("u")))
    raw = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.concat(F.lit("{torn "), text)).otherwise(body)
    return o.select(k.alias("id"), F.col("o_orderstatus").alias("tool"), raw.alias("arguments"))


def ax_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.accessed(calls(spark, sf_dir))


def ax_things(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.register(calls(spark, sf_dir))[0]


def ax_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.register(calls(spark, sf_dir))[1]


QUERIES = {f.__name__: f for f in (ax_walk, ax_things, ax_coverage)}

# ---- SQL

WALK = f"""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS tool, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS readable, o_orderpriority AS p FROM orders),
l AS (SELECT id, tool, unnest([{{'spot': 1, 'kind': 'file', 'v': '/data/' || id % 50, 'name': '/data/' || id % 50}}, {{'spot': 2, 'kind': 'url', 'v': 'https://u:p@Host.example:8' || id % 10 || '/a/' || id % 7 || '?q=1#f', 'name': 'https://host.example:8' || id % 10 || '/a/' || id % 7}},
  {{'spot': 3, 'kind': 'file', 'v': './x/' || id % 9, 'name': './x/' || id % 9}}, {{'spot': 4, 'kind': 'file', 'v': 'plain', 'name': 'plain'}}, {{'spot': 5, 'kind': 'record', 'v': NULL, 'name': CAST(id % 6 AS VARCHAR)}}, {{'spot': 6, 'kind': 'record', 'v': p, 'name': p}},
  {{'spot': 7, 'kind': 'file', 'v': './x/1', 'name': './x/1'}}, {{'spot': 8, 'kind': 'file', 'v': 'file:///etc/hosts', 'name': '/etc/hosts'}}], recursive := true) FROM o WHERE readable),
d AS (SELECT id, tool, spot, kind, name, '{JSON_RECIPE}' || sha256(coalesce('"' || v || '"', name)) AS digest FROM l),
w AS (SELECT id, tool, CAST(row_number() OVER (PARTITION BY id ORDER BY min(spot)) AS INTEGER) AS place, kind, arg_min(name, spot) AS name, digest FROM d GROUP BY id, tool, kind, digest)"""

ORACLE = {
    "ax_walk": f"{WALK} SELECT id, place, kind, name, digest FROM w",
    "ax_things": f"{WALK} SELECT kind, digest, arg_min(name, id) AS name, count(*) AS calls, count(DISTINCT tool) AS tools, min(id) AS first FROM w GROUP BY kind, digest",
    "ax_coverage": f"{WALK} SELECT count(*) AS calls, count(*) FILTER (readable) AS named, count(*) FILTER (NOT readable) AS without_names FROM o",
}
