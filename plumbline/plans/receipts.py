"""Queries on receipts, packs, approvals, checkpoints and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import receipts
from plumbline.session import table

# ---- fixtures


def issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.concat_ws("|", k.cast("string"), "o_orderstatus", "o_orderpriority")
    proves = F.when(k % 31 != 0, F.array(F.lit("the order was placed"))).otherwise(F.array().cast("array<string>"))
    o = table(spark, sf_dir, "orders").select(k.alias("id"), body.alias("body"), proves.alias("proves"), F.when(k % 37 != 0, F.array(F.lit("that it was paid"))).alias("does_not_prove"))
    return receipts.produce(o)


def held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Receipts as they are held, some altered, and the ledger's rows, some lost or under another chain."""
    good = issued(spark, sf_dir).where("state = 'issued'").withColumn("chain", F.substring(F.md5(F.col("id").cast("string")), 1, 32))
    i = F.col("id")
    mine = good.select("id", F.when(i % 11 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("body"), "digest", "chain", F.when(i % 5 == 0, "digest").when(i % 7 == 0, F.reverse("digest")).alias("signed"))
    mine = mine.withColumn("signed", F.when(F.col("signed") == "digest", F.col("digest")).otherwise(F.col("signed")))
    ledger = good.where("id % 13 <> 0").select("digest", F.when(i % 17 == 0, F.reverse("chain")).otherwise(F.col("chain")).alias("chain"))
    return mine, ledger


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("line"), F.concat_ws("|", "event_type", "props").alias("raw"))


def pin_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pin file a brand; bodies and links of some pins were changed."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), F.col("p_name").alias("body"))
    prev = F.when(F.col("line") % 41 == 0, "lost").otherwise(F.coalesce(F.lag("own").over(Window.partitionBy("file").orderBy("line")), F.lit("genesis")))
    own = p.withColumn("own", F.substring(F.md5(F.col("line").cast("string")), 1, 32)).withColumn("prev", prev)
    return own.select("file", "line", "body", "prev", F.when(F.col("line") % 3 == 0, F.substring(F.sha2(F.concat("prev", "body"), 256), 1, 32)).otherwise(F.col("own")).alias("self"))


def actions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("digest"))
    k = F.col("k")
    chain = lambda step: F.md5(F.concat(F.lit(step), k.cast("string")))
    proposed = o.select("digest", chain("p").alias("chain"))
    decided = o.where("k % 7 <> 0").select("digest", F.when(k % 19 == 0, "other").otherwise(chain("p")).alias("cites"), F.when(k % 3 == 0, "denied").otherwise("approved").alias("decision"), chain("d").alias("chain"))
    executed = o.where("k % 5 <> 0").select("digest", chain("d").alias("cites"), F.when(k % 4 == 1, F.reverse("digest")).when((k % 3 != 0) | (k % 8 == 2), F.col("digest")).alias("ran_digest"))
    return proposed, decided, executed


# ---- queries


def rp_produce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issued(spark, sf_dir).select("id", "digest", "state")


def rp_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.verify(*held(spark, sf_dir))


def rp_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rp_verify(spark, sf_dir).withColumn("batch", F.col("id") % 10)
    return receipts.batch(found, "batch")


def rp_sibling(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    c = table(spark, sf_dir, "customer")
    mine = c.select(F.concat(F.lit("runs/"), F.col("c_nationkey").cast("string"), F.lit("/r"), k, F.lit(".json")).alias("path"), F.lit("ledger.jsonl").alias("ledger_name"))
    known = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.concat(F.lit("runs/"), F.col("n_nationkey").cast("string"), F.lit("/ledger.jsonl")).alias("path"))
    return receipts.sibling(mine, known)


def ev_window_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = lines(spark, sf_dir)
    window = source.withColumn("raw", F.when(F.col("line") % 71 == 0, F.concat("raw", F.lit(" "))).otherwise(F.col("raw")))
    return receipts.window_check(window, source.where("line % 83 <> 0"))


def ev_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")
    manifest = d.where("doc_id % 23 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    files = d.where("doc_id % 29 <> 0").select("path", F.when(F.col("doc_id") % 31 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("content"))
    return receipts.manifest_check(manifest, files)


def ev_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of a pack rolled up to the worst, by pack."""
    from plumbline.functions.verdicts import worst_of

    found = ev_manifest(spark, sf_dir).withColumn("pack", F.length("path"))
    return found.groupBy("pack").agg(F.count("*").alias("checks"), worst_of(F.col("finding"), ["differs", "missing", "unlisted", "good"]).alias("worst"))


def ap_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.approval_gate(*actions(spark, sf_dir))


def ct_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    due = table(spark, sf_dir, "customer").select(k.alias("id"))
    i = F.col("id")
    stored = due.where("id % 2 = 0").select("id", F.when(i % 10 == 0, "contained").when(i % 14 == 0, "divergent").otherwise("faithful").alias("scored"))
    return receipts.checkpoint(due, due.where("id % 3 <> 0"), stored, due.where("id % 11 = 0"))


def ct_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = li.select(
        k.alias("id"), F.when(k % 4 != 0, F.col("l_shipdate")).alias("delivered_at"), F.col("o_orderdate").alias("deadline"), (k % 5 == 0).alias("refused"), (k % 10 != 0).alias("attributed"), (k % 15 != 0).alias("anchored"), (k % 13 == 0).alias("contested"), (k % 17 != 0).alias("verifiable"), (k % 19 != 0).alias("witness_live")
    )
    return receipts.delivery(rows)


def ct_binds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ledger_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("line"))
    last = e.groupBy("ledger_id").agg(F.floor(F.max("line") / 2).alias("rows"))
    return receipts.binds(e, last).groupBy("ledger_id").agg(F.count_if("bound").alias("bound"), F.count_if(~F.col("bound")).alias("open"))


def wn_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.pin_file_check(pin_file(spark, sf_dir)).groupBy("file", "finding").agg(F.count("*").alias("n"), F.min("line").alias("first"))


def rc_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    pins = table(spark, sf_dir, "supplier").select(k.alias("pin"), F.when(k % 3 == 0, "agent").when(k % 3 == 1, "tool").alias("side"), F.when(k % 2 == 0, "ns1").otherwise("ns9").alias("ns"))
    r = F.col("r_regionkey")
    tapes = table(spark, sf_dir, "region").where("r_regionkey < 2").select(r.alias("tape"), F.when(r == 0, "agent").otherwise("tool").alias("side"), F.concat(F.lit("ns"), r.cast("string")).alias("ns"))
    return receipts.route_pins(pins, tapes)


def ex_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e.alias("id"), F.col("event_type").alias("action"), F.when(e % 2 == 0, F.col("user_id")).alias("agent"), F.when(e % 3 == 0, "ok").alias("outcome"))
    return receipts.export_record(rows)


def dl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deal's own rows by kind, with the stored digest held against a new one."""
    k = F.col("o_orderkey")
    body = F.concat_ws("|", k.cast("string"), "o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.when(k % 3 == 0, "note.").otherwise("deal."), "o_orderstatus").alias("kind"), F.col("o_custkey").alias("deal"), body.alias("body"), receipts.body_digest(F.when(k % 10 == 3, F.concat(body, F.lit("?"))).otherwise(body)).alias("stored"))
    return rows.where(F.col("kind").startswith("deal.")).groupBy("deal", "kind").agg(F.count("*").alias("n"), F.count_if(receipts.body_digest(F.col("body")) != F.col("stored")).alias("changed"))


QUERIES = {f.__name__: f for f in (rp_produce, rp_verify, rp_batch, rp_sibling, ev_window_check, ev_manifest, ev_worst, ap_gate, ct_checkpoint, ct_delivery, ct_binds, wn_file, rc_route, ex_record, dl_rows)}

# ---- SQL

HELD = """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority AS body, o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0 AS ok FROM orders),
d AS (SELECT id, body, 'sha256:raw-bytes:v1:' || sha256(body) AS digest, ok FROM o)"""
VERIFIED = HELD + """, v AS (SELECT id, id % 11 <> 0 AS body_ok, CASE WHEN id % 13 <> 0 THEN id % 17 <> 0 END AS row_ok, CASE WHEN id % 5 = 0 THEN true WHEN id % 7 = 0 THEN false END AS signature_ok FROM d WHERE ok),
w AS (SELECT *, CASE WHEN NOT body_ok THEN 'tampered' WHEN NOT coalesce(row_ok, true) OR NOT coalesce(signature_ok, true) THEN 'mismatch' WHEN row_ok IS NULL THEN 'could_not_look' ELSE 'good' END AS verdict FROM v)"""
MANIFEST = """WITH m AS (SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 29 = 0 THEN 'missing' WHEN doc_id % 23 = 0 THEN 'unlisted' WHEN doc_id % 31 = 0 THEN 'differs' ELSE 'good' END AS finding FROM documents WHERE doc_id % 29 <> 0 OR doc_id % 23 <> 0)"""

ORACLE = {
    "rp_produce": HELD + " SELECT id, digest, CASE WHEN ok THEN 'issued' ELSE 'refused' END AS state FROM d",
    "rp_verify": VERIFIED + " SELECT * FROM w",
    "rp_batch": VERIFIED + """ SELECT id % 10 AS batch, count(*) AS n, count(*) FILTER (verdict = 'tampered') AS tampered, count(*) FILTER (verdict = 'mismatch') AS mismatch, count(*) FILTER (verdict = 'could_not_look') AS could_not_look, count(*) FILTER (verdict = 'good') AS good,
  CASE WHEN bool_or(verdict = 'tampered') THEN 'tampered' WHEN bool_or(verdict = 'mismatch') THEN 'mismatch' WHEN bool_or(verdict = 'could_not_look') THEN 'could_not_look' ELSE 'good' END AS worst FROM w GROUP BY 1""",
    "rp_sibling": "SELECT 'runs/' || c_nationkey || '/r' || c_custkey || '.json' AS path, CASE WHEN c_nationkey % 3 <> 0 THEN 'runs/' || c_nationkey || '/ledger.jsonl' END AS ledger_path FROM customer",
    "ev_window_check": "SELECT event_id AS line, CASE WHEN event_id % 83 = 0 THEN 'missing_in_source' ELSE 'differs' END AS finding FROM events WHERE event_id % 83 = 0 OR event_id % 71 = 0",
    "ev_manifest": MANIFEST + " SELECT path, finding FROM m",
    "ev_worst": MANIFEST + " SELECT length(path) AS pack, count(*) AS checks, CASE WHEN bool_or(finding = 'differs') THEN 'differs' WHEN bool_or(finding = 'missing') THEN 'missing' WHEN bool_or(finding = 'unlisted') THEN 'unlisted' ELSE 'good' END AS worst FROM m GROUP BY 1",
    "ap_gate": """SELECT sha256(o_orderkey || '|' || o_orderstatus) AS digest, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 19 = 0 THEN 'undecided' WHEN o_orderkey % 5 = 0 THEN 'not_closed'
  WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 4 = 1 THEN 'ran_otherwise' ELSE 'as_approved' END WHEN o_orderkey % 4 = 1 OR o_orderkey % 8 = 2 THEN 'denied_but_ran' ELSE 'as_denied' END AS verdict FROM orders""",
    "ct_checkpoint": """SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'refused_explicitly' WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'error_contradictory_evidence' WHEN c_custkey % 3 = 0 THEN 'due_not_attempted' WHEN c_custkey % 2 = 1 THEN 'attempted_no_receipt'
  WHEN c_custkey % 10 = 0 THEN 'receipt_received_contained' WHEN c_custkey % 14 = 0 THEN 'receipt_received_divergent' ELSE 'receipt_received_faithful' END AS outcome FROM customer""",
    "ct_delivery": """WITH l AS (SELECT l_orderkey * 7 + l_linenumber AS id, l_shipdate AS shipped, o_orderdate AS due FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
o AS (SELECT id, CASE WHEN id % 19 = 0 THEN 'witness_liveness_lost' WHEN id % 13 = 0 THEN 'witness_authority_unresolved' WHEN id % 10 = 0 THEN 'refusal_unattributed' WHEN id % 15 = 0 THEN 'refusal_unanchored' WHEN id % 17 = 0 THEN 'receipt_unverifiable'
  WHEN id % 5 = 0 AND id % 4 <> 0 THEN 'delivered_refused' WHEN id % 4 <> 0 AND shipped > due THEN 'delivered_overdue' END AS outcome FROM l) SELECT id, outcome, coalesce(outcome NOT LIKE 'delivered%', false) AS unresolved FROM o""",
    "ct_binds": "WITH n AS (SELECT user_id AS ledger_id, count(*) AS n FROM events GROUP BY 1) SELECT ledger_id, n // 2 AS bound, n - n // 2 AS open FROM n",
    "wn_file": """WITH p AS (SELECT p_brand AS file, p_partkey AS line, p_name AS body, md5(CAST(p_partkey AS VARCHAR)) AS own FROM part),
q AS (SELECT *, CASE WHEN line % 41 = 0 THEN 'lost' ELSE coalesce(lag(own) OVER (PARTITION BY file ORDER BY line), 'genesis') END AS prev FROM p),
r AS (SELECT *, substr(sha256(prev || body), 1, 32) AS want, CASE WHEN line % 3 = 0 THEN substr(sha256(prev || body), 1, 32) ELSE own END AS self FROM q),
s AS (SELECT *, coalesce(lag(self) OVER (PARTITION BY file ORDER BY line), 'genesis') AS before FROM r),
f AS (SELECT file, line, CASE WHEN prev <> before THEN 'prev' WHEN self <> want THEN 'self' END AS finding FROM s) SELECT file, finding, count(*) AS n, min(line) AS first FROM f WHERE finding IS NOT NULL GROUP BY 1, 2""",
    "rc_route": "WITH s AS (SELECT s_suppkey AS k FROM supplier), t AS (SELECT unnest([0, 1]) AS tape) SELECT k AS pin, CAST(tape AS INTEGER) AS tape FROM s, t WHERE CASE WHEN k % 3 = 0 THEN tape = 0 WHEN k % 3 = 1 THEN tape = 1 WHEN k % 2 = 0 THEN tape = 1 ELSE true END",
    "ex_record": """SELECT event_id AS id, '{"action":"' || event_type || '"' || CASE WHEN event_id % 2 = 0 THEN ',"agent":' || user_id ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ',"outcome":"ok"' ELSE '' END || '}' AS record FROM events""",
    "dl_rows": "SELECT o_custkey AS deal, 'deal.' || o_orderstatus AS kind, count(*) AS n, count(*) FILTER (o_orderkey % 10 = 3) AS changed FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2",
}
