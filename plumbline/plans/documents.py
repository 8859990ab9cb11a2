"""Queries on receipts as documents: issued into a store, some of them spoiled, and checked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import documents
from plumbline.session import settled, shared_folder, table
from plumbline.sources import appending


def rp_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt a part, in its brand's ledger; scopes that aren't stated are refused, and of the rest some are altered, ambiguous or without their ledger."""
    k = F.col("p_partkey")
    checks = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), 1 + (k % 3).cast("int")), lambda i: F.concat(F.lit('{"size": '), i.cast("string"), F.lit("}"))), ", "), F.lit("]"))
    scope = F.when(k % 11 == 0, '{"proves": []}').otherwise('{"proves": ["the size"], "does_not_prove": ["the price"]}')
    subject = F.to_json(F.struct(F.col("p_name").alias("name")))
    bodies = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_brand").alias("ledger_id"), k.alias("n"), F.lit("call").alias("kind"), subject.alias("subject"), checks.alias("checks"), scope.alias("scope"), F.lit("{}").alias("extra"))
    folder = f"{shared_folder(spark)}/receipts-{uuid.uuid4().hex}"
    made, refused = documents.issue(spark, folder, bodies, "2026-01-01T00:00:00Z")
    i = F.col("id") % 7
    raw = F.when(i == 1, F.replace("raw", F.lit('"kind": "call"'), F.lit('"kind": "cell"'))).when(i == 2, F.concat(F.lit('{"kind": "x", '), F.expr("substring(raw, 2)"))).when(i == 5, F.expr("substring(raw, 1, 40)")).otherwise(F.col("raw"))
    given = settled(made.select("id", F.when(i == 3, F.lit(None)).when(i == 4, "nowhere").otherwise(F.col("ledger_id")).alias("ledger_id"), raw.alias("raw")))
    found = documents.check(given, appending.read(spark, folder)).select("id", "body_ok", "duplicate_keys", "ledger", "ok")
    return found.unionByName(refused.select("id", F.col("problem").alias("ledger")), allowMissingColumns=True)


QUERIES = {"rp_documents": rp_documents}

ORACLE = {
    "rp_documents": """SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 5 THEN NULL ELSE p_partkey % 7 <> 1 END AS body_ok, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 5 THEN NULL ELSE p_partkey % 7 = 2 END AS duplicate_keys,
  CASE WHEN p_partkey % 11 = 0 THEN 'the scope is not stated' WHEN p_partkey % 7 = 3 THEN 'not_checked' WHEN p_partkey % 7 = 4 THEN 'missing' WHEN p_partkey % 7 <> 5 THEN 'consistent' END AS ledger,
  CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 7 NOT IN (4, 5) THEN p_partkey % 7 NOT IN (1, 2) END AS ok FROM part"""
}
