"""Queries on texts cut to a budget with receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import distill
from plumbline.session import table

QUERY = "license the of and 7"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool results of four kinds: prose, nested JSON, JSON rows and delimited text."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    e = table(spark, sf_dir, "events").withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    row = F.struct("event_id", "at", "event_type", F.repeat("props", 1 + (F.col("event_id") % 40).cast("int")).alias("props"))
    lists = e.groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    nested = lists.select(F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("id"), F.to_json(F.struct("user_id", "rows", F.map_from_entries(F.transform("rows", lambda r: F.struct(r["event_id"].cast("string"), r["event_type"]))).alias("types"))).alias("text"))
    listed = lists.select(F.concat(F.lit("r"), F.col("user_id").cast("string")), F.to_json("rows"))
    lines = F.transform("rows", lambda r: F.concat_ws(",", r["event_id"].cast("string"), r["at"], r["event_type"]))
    tables = lists.select(F.concat(F.lit("t"), F.col("user_id").cast("string")), F.concat(F.lit("id,at,type\n"), F.array_join(lines, "\n")))
    return docs.unionAll(nested).unionAll(listed).unionAll(tables)


def ds_distill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result cut to 200 tokens: sizes, what was dropped, and what its receipt is when read back."""
    found = distill.distill(results(spark, sf_dir), 200, QUERY)
    count = F.aggregate("receipt.drops", F.lit(0).cast("long"), lambda n, d: n + d["dropped_count"])
    return found.select("id", "strategy", F.length("content").alias("size"), F.sha2("content", 256).alias("digest"), F.size("receipt.drops").alias("drops"), count.alias("dropped"), distill.receipt_state(F.to_json("receipt")).alias("state"))


def ds_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's sentences that fit 600 characters, with a query."""
    cut = distill.prose_cut(F.col("text"), 600, QUERY)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", cut.alias("c")).select("doc_id", "c.content", F.coalesce(F.get("c.drops", F.lit(0))["dropped_count"], F.lit(0)).alias("dropped"), F.get("c.drops", F.lit(0))["digest"].alias("digest"))


def ds_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as lines, cut to 400 characters."""
    o = table(spark, sf_dir, "orders")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    made = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
    text = F.concat(F.lit("key,status,priority\n---|---\n"), F.array_join(F.flatten(F.array_repeat(F.col("l.line"), 5)), "\n"))
    return made.select("o_custkey", distill.table_cut(text, 400).alias("c")).select("o_custkey", "c.content", F.coalesce(F.get("c.drops", F.lit(0))["dropped_bytes"], F.lit(0)).alias("dropped_bytes"))


QUERIES = {f.__name__: f for f in (ds_distill, ds_select, ds_table)}

# ---- SQL

ORACLE = {
    "ds_select": rf"""WITH RECURSIVE d AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL),
q AS (SELECT list_distinct(regexp_extract_all(lower('{QUERY}'), '[a-z0-9]+')) AS asked),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x, unnest(range(len(s))) AS i FROM d WHERE length(text) > 600),
w AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY greatest(1.0::DOUBLE / (i + 1), 1.0::DOUBLE / (n - i)) + 2 * len(list_intersect(list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')), asked)) DESC, i) AS r, length(x) + 1 AS cost FROM e, q),
f AS (SELECT doc_id, 0::BIGINT AS r, 0::BIGINT AS used, -1::BIGINT AS took FROM d UNION ALL
  SELECT f.doc_id, w.r, CASE WHEN f.r = 0 OR (used < 600 AND used + cost <= 600) THEN used + cost ELSE used END, CASE WHEN f.r = 0 OR (used < 600 AND used + cost <= 600) THEN i ELSE -1 END FROM f JOIN w ON w.doc_id = f.doc_id AND w.r = f.r + 1),
k AS (SELECT w.*, coalesce(took, -1) = i AS kept FROM w JOIN f ON f.doc_id = w.doc_id AND f.r = w.r),
g AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k WHERE kept),
o AS (SELECT doc_id, string_agg(CASE WHEN before < i - 1 THEN '[...] ' ELSE '' END || x, ' ' ORDER BY i) AS content FROM g GROUP BY 1),
l AS (SELECT doc_id, count(*) AS dropped, 'sha256:raw-bytes:v1:' || sha256(string_agg(x, ' ' ORDER BY i)) AS digest FROM k WHERE NOT kept GROUP BY 1)
SELECT d.doc_id, coalesce(content, text) AS content, coalesce(dropped, 0) AS dropped, digest FROM d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id""",
    "ds_table": """WITH r AS (SELECT o_custkey, k, list(o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority ORDER BY o_orderkey) AS l FROM orders, (SELECT unnest(range(5)) AS k) GROUP BY ALL),
b AS (SELECT o_custkey, flatten(list(l ORDER BY k)) AS l FROM r GROUP BY 1),
c AS (SELECT o_custkey, l, cap, len(l) AS n, greatest(len(l) - cap, 0) AS gone, (cap + 1) // 2 AS h FROM b, (SELECT unnest([40, 20, 10, 5, 4]) AS cap)),
t AS (SELECT *, 'key,status,priority' || chr(10) || '---|---' || chr(10) || array_to_string(CASE WHEN gone = 0 THEN l ELSE l[1:h] || ['...+' || gone || ' rows dropped...'] || l[n - cap // 2 + 1:n] END, chr(10)) AS content FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN length(content) <= 400 OR gone = 0 OR cap = 4 THEN 0 ELSE 1 END, cap DESC) AS place FROM t)
SELECT o_custkey, content, CASE WHEN gone = 0 THEN 0 ELSE strlen(array_to_string(l[h + 1:h + gone], chr(10))) END AS dropped_bytes FROM p WHERE place = 1""",
}
