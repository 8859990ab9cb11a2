"""Queries on ledgers that grow, on what may be appended to them, and on files that are read whole or refused."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import lookups, readings
from plumbline.session import shared_folder, table
from plumbline.sources import appending, validated


def led_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger a user, appended in two batches to a store and read back."""
    e = table(spark, sf_dir, "events")
    raw = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "id": '), F.col("event_id").cast("string"), F.lit("}"))
    records = e.select(F.col("user_id").cast("string").alias("ledger_id"), F.col("event_id").alias("n"), raw.alias("raw"))
    folder = f"{shared_folder(spark)}/ledgers-{uuid.uuid4().hex}"
    half = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0] or 0
    appending.append(spark, folder, records.where(F.col("n") <= half), stamp=False)
    appending.append(spark, folder, records.where(F.col("n") > half), stamp=False)
    return appending.read(spark, folder).select("ledger_id", "line", F.get_json_object("raw", "$.id").cast("long").alias("event_id"), F.get_json_object("raw", "$.chain").alias("chain"))


def rd_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a batch: what users say are criteria, some of which revise what was said two turns before; the rest reads by the turn before."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("ledger_id"), F.col("turn").alias("n"), "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("own"))
    said = lambda k, name: c.select("ledger_id", (F.col("n") + k).alias("n"), F.col("own").alias(name))
    rows = c.join(said(1, "last"), ["ledger_id", "n"], "left").join(said(2, "older"), ["ledger_id", "n"], "left")
    user = F.col("role") == "user"
    none = F.lit(None).cast("string")
    batch = rows.select(
        "ledger_id",
        "n",
        F.when(user, "criterion").otherwise("reading").alias("evt"),
        F.when(user, F.col("own")).otherwise(F.coalesce("last", F.lit("none"))).alias("sha"),
        F.when(user & (F.col("n") % 4 != 0), F.col("older")).alias("supersedes"),
        none.alias("raw"),
        F.when(F.col("n") % 11 == 10, "spoiled").alias("problem"),
    )
    known = spark.createDataFrame([], "ledger_id string, sha string")
    return readings.guarded(batch, known).select("ledger_id", "n", "evt", F.coalesce("problem", F.lit("taken")).alias("state"))


def ci_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalized words of documents as citations, against a service that limits some of them at first."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    pattern = "[A-Z][a-z]{6,}"
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1))).alias("cite")).distinct()
    each = words.select("cite", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt"))
    limited = (F.length("cite") + F.col("attempt")) % 4 == 0
    answers = each.where("length(cite) % 7 <> 1").select("cite", "attempt", F.when(limited, lookups.LIMITED).otherwise("found").alias("status"))
    found = lookups.look_up(docs, answers, pattern, most=2000, per_request=20, rounds=2)
    return found.groupBy("key", "status").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("attempts").alias("attempts"))


def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a claims file of documents: some torn, without or with repeated ids, with other types."""
    d = table(spark, sf_dir, "documents")
    k, text = F.col("doc_id"), F.col("doc_id").cast("string")
    name = F.when(k % 13 == 0, F.lit('"claim_id": 5')).when(k % 17 == 0, F.lit('"claim_id": " "')).when(k % 19 == 0, F.concat(F.lit('"claim_id": "c'), (k % 38).cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('"claim_id": "d'), text, F.lit('"')))
    claim = F.when(k % 23 == 0, F.lit("")).otherwise(F.concat(F.lit(', "claim": "'), F.col("lang"), F.lit('"')))
    near = F.when(k % 29 == 0, F.lit(', "near_match_id": ""')).when(k % 31 == 0, F.lit(', "near_match_id": null')).otherwise(F.lit(""))
    raw = F.when(k % 37 == 0, F.lit("{torn")).when(k % 41 == 0, F.lit("[1]")).when(k % 43 == 0, F.lit("  ")).otherwise(F.concat(F.lit("{"), name, claim, near, F.lit("}")))
    return d.select(F.lit("claims").alias("ledger_id"), k.alias("line"), raw.alias("raw"))


def rd_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated.claims(claim_lines(spark, sf_dir)).select("line", "claim_id", "claim", "near_match_id", "problem")


QUERIES = {f.__name__: f for f in (led_append, rd_guard, ci_lookup, rd_claims)}

# ---- SQL

ORACLE = {
    "led_append": """WITH RECURSIVE b AS (SELECT CAST(user_id AS VARCHAR) AS ledger_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, event_id, '{"id": ' || event_id || ', "type": "' || event_type || '"}' AS body FROM events),
c AS (SELECT ledger_id, line, event_id, substr(sha256('genesis' || body), 1, 32) AS chain FROM b WHERE line = 1 UNION ALL SELECT b.ledger_id, b.line, b.event_id, substr(sha256(c.chain || b.body), 1, 32) FROM b JOIN c ON b.ledger_id = c.ledger_id AND b.line = c.line + 1)
SELECT * FROM c""",
    "rd_guard": """WITH RECURSIVE t AS (SELECT CAST(conv_id AS VARCHAR) AS ledger_id, turn AS n, role = 'user' AS criterion, sha256(coalesce(text, '')) AS own, turn % 11 = 10 AS spoiled FROM conversations),
b AS (SELECT t.ledger_id, t.n, t.criterion, t.spoiled, CASE WHEN t.criterion THEN t.own ELSE coalesce(l.own, 'none') END AS sha, CASE WHEN t.criterion AND t.n % 4 <> 0 THEN o.own END AS supersedes
  FROM t LEFT JOIN t l ON l.ledger_id = t.ledger_id AND l.n = t.n - 1 LEFT JOIN t o ON o.ledger_id = t.ledger_id AND o.n = t.n - 2),
a AS (SELECT ledger_id, n, sha FROM b WHERE criterion AND NOT spoiled AND supersedes IS NULL UNION SELECT b.ledger_id, b.n, b.sha FROM b JOIN a ON a.ledger_id = b.ledger_id AND a.sha = b.supersedes AND a.n < b.n WHERE criterion AND NOT spoiled)
SELECT ledger_id, n, CASE WHEN criterion THEN 'criterion' ELSE 'reading' END AS evt, CASE WHEN spoiled THEN 'spoiled' WHEN CASE WHEN criterion THEN supersedes ELSE sha END IS NULL OR exists(SELECT 1 FROM a WHERE a.ledger_id = b.ledger_id AND a.n < b.n AND a.sha = CASE WHEN b.criterion THEN b.supersedes ELSE b.sha END) THEN 'taken'
  WHEN criterion THEN 'supersedes no earlier criterion' ELSE 'criterion is not frozen earlier' END AS state FROM b""",
    "rd_claims": """WITH l AS (SELECT doc_id AS line, lang, CASE WHEN doc_id % 37 = 0 THEN 'torn' WHEN doc_id % 41 = 0 THEN 'list' WHEN doc_id % 43 = 0 THEN 'blank' ELSE 'object' END AS shape,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN ' ' WHEN doc_id % 19 = 0 THEN 'c' || doc_id % 38 ELSE 'd' || doc_id END AS claim_id, CASE WHEN doc_id % 23 <> 0 THEN lang END AS claim, CASE WHEN doc_id % 29 = 0 THEN '' END AS near_match_id FROM documents),
o AS (SELECT line, shape, CASE WHEN shape = 'object' THEN claim_id END AS claim_id, CASE WHEN shape = 'object' THEN claim END AS claim, CASE WHEN shape = 'object' THEN near_match_id END AS near_match_id FROM l WHERE shape <> 'blank'),
p AS (SELECT *, CASE WHEN shape = 'torn' THEN 'invalid JSON' WHEN shape = 'list' THEN 'not a JSON object' WHEN trim(coalesce(claim_id, '')) = '' THEN 'claim_id must be a non-empty string' WHEN claim IS NULL THEN 'claim must be a string' WHEN near_match_id = '' THEN 'near_match_id must be a non-empty string' END AS first,
  row_number() OVER (PARTITION BY claim_id ORDER BY line) AS nth FROM o)
SELECT line, claim_id, claim, near_match_id, coalesce(first, CASE WHEN claim_id IS NOT NULL AND nth > 1 THEN 'claim_id appears twice' END) AS problem FROM p""",
}
