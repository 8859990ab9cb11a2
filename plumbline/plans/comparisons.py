"""Comparison queries: tapes, raters, deals, handshakes, snapshots, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import deals, raters, tapes
from plumbline.session import table

# ---- fixtures


def tape_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One side of each user's events as calls; the other lost, altered and muted some."""
    e = table(spark, sf_dir, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    calls = e.select(F.col("user_id").cast("string").alias("session"), "event_id", idx.alias("idx"), F.col("event_type").alias("req"), F.col("props").alias("resp"))
    other = calls.where("event_id % 97 <> 0").withColumn("resp", F.when(F.col("event_id") % 101 == 0, "altered").when(F.col("event_id") % 103 == 0, F.lit(None)).otherwise(F.col("resp")))
    return calls, other


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes with gaps, repeats and steps back, in file order."""
    calls, _ = tape_pair(spark, sf_dir)
    idx = F.when(F.col("event_id") % 41 == 0, F.col("idx") + 3).when(F.col("event_id") % 43 == 0, F.greatest(F.col("idx") - 2, F.lit(1))).otherwise(F.col("idx"))
    return calls.select("session", F.col("event_id").alias("pos"), idx.alias("idx"))


def two_raters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    a = labels.select(F.col("doc_id").alias("claim_id"), F.lit("c").alias("claim_sha"), F.lit("k1").alias("criterion_sha"), F.lit("Rater A").alias("reader"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("reading"))
    i = F.col("doc_id")
    b = docs.where("doc_id % 4 <> 1").select(
        i.alias("claim_id"),
        F.when(i % 10 == 0, "d").otherwise("c").alias("claim_sha"),
        F.when(i % 10 == 2, "k2").otherwise("k1").alias("criterion_sha"),
        F.when(i % 10 == 4, " rater a").otherwise("Rater B").alias("reader"),
        F.when(F.col("n_chars") > 1000, "yes").otherwise("no").alias("reading"),
    )
    return a, b


def two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as the buyer's commits by customer; the seller's lack some and differ in others."""
    o = table(spark, sf_dir, "orders")
    b = o.select(F.col("o_custkey").alias("deal"), F.lit("commit").alias("step"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    s = b.where("pos % 97 <> 0").withColumn("priority", F.when(F.col("pos") % 89 == 0, "other").otherwise(F.col("priority"))).withColumn("status", F.when(F.col("pos") % 178 == 0, "X").otherwise(F.col("status")))
    return b, s


def deal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal"), F.col("o_orderdate").alias("ts"))
    shift = lambda col, m: (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=col)).alias("ts")  # noqa: E731, ARG005
    ship = o.where("deal % 3 <> 0").select("deal", F.lit("ship").alias("step"), shift((F.col("deal") % 100).cast("int"), 0))
    cancel = o.where("deal % 5 = 0").select("deal", F.lit("cancel").alias("step"), (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=F.lit(40), secs=F.lit(30))).alias("ts"))
    return ship.unionAll(cancel)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that supersede earlier ones: forks, some resolved once, some twice and differently."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    k = F.col("k")
    ident = lambda x: F.concat(F.lit("r"), x.cast("string"))
    old = (
        F.when(k % 10 == 2, F.array(ident(k - 1)))
        .when((k % 10).isin(3, 4), F.array(ident(k - k % 10 + 1)))
        .when((k % 10 == 6) & (k % 20 < 10), F.array(ident(k - 4), ident(k - 3), ident(k - 2)))
        .when((k % 10 == 7) & (k % 30 < 10), F.array(ident(k - 5), ident(k - 4)))
    )
    return p.select(k.alias("pos"), ident(k).alias("id"), F.coalesce(old, F.array().cast("array<string>")).alias("supersedes"))


# ---- queries


def rc_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapes.outer(*tape_pair(spark, sf_dir)).groupBy("session", "verdict").agg(F.count("*").alias("calls"))


def rc_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapes.index_findings(positions(spark, sf_dir))


def rc_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapes.align(*tape_pair(spark, sf_dir))


def rc_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, _ = tape_pair(spark, sf_dir)
    e = F.col("event_id")
    findings = calls.select("session", F.when(e % 2 == 0, "ALTERED").otherwise("MISSING").alias("verdict"), F.when(e % 3 != 0, F.floor(F.col("idx") / 10)).alias("at"), F.when(e % 5 < 2, "agent").otherwise("tool").alias("side"))
    return tapes.headline(findings)


def rc_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, _ = tape_pair(spark, sf_dir)
    tape = calls.select("session", "idx", F.md5(F.col("event_id").cast("string")).alias("chain"))
    pins = tape.where("idx % 25 = 0").select("session", F.when(F.col("idx") % 50 == 0, F.col("idx") + 40).otherwise(F.col("idx")).alias("rows"), F.upper("chain").alias("chain"))
    return tapes.check_pins(pins, tape)


def gr_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapes.supersedes(edges(spark, sf_dir))["forks"]


def gr_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapes.supersedes(edges(spark, sf_dir))["resolved"]


def gr_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapes.supersedes(edges(spark, sf_dir))["conflicts"]


def rd_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raters.compare_readings(*two_raters(spark, sf_dir))


def rd_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raters.summarize_statuses(rd_compare(spark, sf_dir))


def rd_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("claim_id"), "event_id", "props")
    return raters.latest(e, "claim_id", "event_id")


def rd_citation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ledger"), F.col("turn").alias("line"), "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    # an answer quotes the turn before it word for word now and then, as its criterion
    before = c.select("ledger", (F.col("line") + 1).alias("line"), F.col("sha").alias("quoted"))
    c = c.join(before, ["ledger", "line"], "left").withColumn("sha", F.when(F.col("line") % 3 == 1, F.coalesce("quoted", "sha")).otherwise(F.col("sha"))).drop("quoted")
    return raters.citation_order(c.where("role = 'user'"), c.where("role <> 'user'"))


def rd_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    say = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Yes, "), "text")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("  NO. "), "text")).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Yesterday "), "text")).otherwise(F.lit(""))
    return d.select("doc_id", raters.parse_answer(say).alias("reading"))


def dl_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deals.compare(*two_sides(spark, sf_dir), ["status", "priority"]).where("finding <> 'same'")


def dl_dispute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deals.verdicts(deals.compare(*two_sides(spark, sf_dir), ["status", "priority"]))


def dl_pin_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, _ = tape_pair(spark, sf_dir)
    rows = calls.select(F.col("session").alias("party"), F.col("idx").alias("n"))
    pins = calls.where("event_id % 17 = 0").select(F.col("session").alias("party"), F.col("idx").alias("rows"), F.concat(F.lit("t"), F.lpad((F.col("event_id") * 7919 % 1000).cast("string"), 4, "0")).alias("as_of"))
    return deals.pin_bound(rows, pins)


def dl_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deals.position(deal_steps(spark, sf_dir))


def hs_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    p = o.where("o_orderkey % 11 <> 0").select(F.col("o_custkey").alias("id"), k.alias("pos"), F.when(k % 13 != 0, F.col("o_orderpriority")).alias("terms"), k.alias("row"))
    a = o.where("o_orderkey % 11 <> 1").select(F.col("o_custkey").alias("id"), k.alias("pos"), F.when(k % 7 == 0, "other").otherwise(F.col("o_orderpriority")).alias("terms"), F.when(k % 5 == 0, k + 1).otherwise(k).alias("cited_row"))
    return deals.handshake(p, a)


def ct_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the parts that come in have ids of their own kind, so none is taken for an old part, however large keys get
    named = lambda new: F.struct(F.lit(new).alias("new"), F.col("p_partkey").alias("key")).alias("id")
    p = table(spark, sf_dir, "part").withColumnRenamed("p_type", "value")
    came = p.where("p_partkey % 29 = 0").withColumn("p_partkey", F.col("p_partkey") + 1000000).select(named(True), "value")
    changed = F.when(F.col("p_partkey") % 23 == 0, F.concat("value", F.lit("+"))).otherwise(F.col("value")).alias("value")
    after = p.where("p_partkey % 19 <> 0").select(named(False), changed).unionAll(came)
    found = raters.snapshot_diff(p.select(named(False), "value"), after).where("change <> 'unchanged'")
    return found.select("id.key", "change").withColumnRenamed("key", "id")


def ct_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("field"), F.col("p_name").alias("id"), F.col("p_partkey").alias("k"))
    names = p.select("field", F.concat_ws("-", "id", F.col("k").cast("string")).alias("id"), "k")
    return raters.added_fields(names, names.where("k % 31 <> 0"))


def ct_restate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    manifest = n.groupBy(F.col("n_regionkey").cast("string").alias("field")).agg(F.array_sort(F.collect_list("n_name")).alias("items")).unionAll(n.where("n_nationkey = 3").select(F.lit("only"), F.array("n_name")))
    return raters.restate(manifest)


def ct_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("value"), F.col("c_mktsegment").alias("tier"))
    i = F.col("id")
    said = c.where("id % 9 <> 0").select("id", F.when(i % 5 == 0, F.concat(F.lit("it is "), "value")).when(i % 7 == 0, F.lit("no")).otherwise(F.concat(F.lit(" "), "value", F.lit(" "))).alias("value"))
    return raters.restatement_check(c, said, c.where("id % 2 = 0"), strict=False)


def ct_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By grade: the shares of faithful answers and of agreement with what was expected."""
    found = ct_verify(spark, sf_dir).withColumn("grade", F.concat(F.lit("D"), (F.col("id") % 6).cast("string"))).withColumn("faithful", F.col("outcome") == "faithful").withColumn("expected", F.col("id") % 4 != 0)
    same = (F.col("faithful") == F.col("expected")).cast("int")
    wrong = F.min(F.when(same == 0, F.col("id")))
    return found.groupBy("grade").agg(F.count("*").alias("n"), F.round(F.avg(F.col("faithful").cast("int")), 4).alias("faithful_rate"), F.round(F.avg(same), 4).alias("agreement"), wrong.alias("first_disagreeing"))


def gd_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("item")).distinct()
    base = p.where("length(item) % 5 <> 0").withColumn("accepted", F.col("item").rlike("[aeiou]{2}"))
    return raters.gate_drift(base, p, "[aeo]{2}|st")


def gd_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("item")).distinct().where(F.col("item").rlike("[aeo]{2}"))


CITATION = "[0-9]+ [A-Z][a-z]+ [0-9]+"


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with references such as `12 Part 7`, drawn from the line items."""
    li = table(spark, sf_dir, "lineitem")
    cite = F.concat(F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") == 1, " Part ").otherwise(" Supp "), F.col("l_partkey").cast("string"))
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(cite)), "; see ").alias("text"))


def ci_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(CITATION), 0)).alias("cite"))


def ci_unrecognized(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ci_extract(spark, sf_dir)
    known = found.where("length(cite) % 4 <> 0").withColumn("cite", F.concat(F.lit(" "), F.upper("cite")))
    return raters.unrecognized(found, known)


def ci_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ci_extract(spark, sf_dir).groupBy(F.when(F.length("cite") % 4 == 0, "flagged").when(F.length("cite") % 4 == 1, "not_checked").otherwise("ok").alias("status")).agg(F.count("*").alias("n"), F.min("cite").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (rc_outer, rc_gaps, rc_align, rc_headline, rc_pins, gr_forks, gr_resolved, gr_conflicts, rd_compare, rd_summary, rd_latest, rd_citation_order, rd_parse, dl_compare, dl_dispute, dl_pin_bound, dl_position, hs_verify, ct_diff, ct_added, ct_restate, ct_verify, ct_curve, gd_drift, gd_accept, ci_extract, ci_unrecognized, ci_summary)
}

# ---- SQL

CALLS = "WITH calls AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, event_type AS req, props AS resp FROM events)"
EDGES = """WITH p AS (SELECT p_partkey AS k FROM part),
rows AS (SELECT k AS pos, 'r' || k AS id, CASE WHEN k % 10 = 2 THEN ['r' || (k - 1)] WHEN k % 10 IN (3, 4) THEN ['r' || (k - k % 10 + 1)]
  WHEN k % 10 = 6 AND k % 20 < 10 THEN ['r' || (k - 4), 'r' || (k - 3), 'r' || (k - 2)] WHEN k % 10 = 7 AND k % 30 < 10 THEN ['r' || (k - 5), 'r' || (k - 4)] END AS s FROM p),
e AS (SELECT pos, id, unnest(s) AS old FROM rows),
forks AS (SELECT old, count(DISTINCT id) AS n, max(pos) AS last FROM e GROUP BY 1 HAVING count(DISTINCT id) >= 2),
members AS (SELECT DISTINCT f.old, f.last, f.n, e.id AS claimant FROM forks f JOIN e ON e.old = f.old),
named AS (SELECT m.old, m.n, r.pos, r.id, m.claimant FROM members m JOIN e r ON r.old = m.claimant WHERE r.pos > m.last),
cov AS (SELECT old, pos, id, max(n) AS n, list_sort(list(DISTINCT claimant)) AS hit FROM named GROUP BY 1, 2, 3 HAVING count(DISTINCT claimant) >= 2)"""
RATERS = """WITH a AS (SELECT doc_id AS claim_id, 'c' AS t, 'k1' AS k, 'rater a' AS r, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS v FROM labels),
b AS (SELECT doc_id AS claim_id, CASE WHEN doc_id % 10 = 0 THEN 'd' ELSE 'c' END AS t, CASE WHEN doc_id % 10 = 2 THEN 'k2' ELSE 'k1' END AS k, CASE WHEN doc_id % 10 = 4 THEN 'rater a' ELSE 'rater b' END AS r, CASE WHEN n_chars > 1000 THEN 'yes' ELSE 'no' END AS v FROM documents WHERE doc_id % 4 <> 1),
s AS (SELECT coalesce(a.claim_id, b.claim_id) AS claim_id, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'MISSING' WHEN a.t <> b.t THEN 'COULD_NOT_LOOK_TEXT' WHEN a.k <> b.k THEN 'COULD_NOT_LOOK_CRITERION' WHEN a.r = b.r THEN 'COULD_NOT_LOOK_SAME_READER' WHEN a.v = b.v THEN 'AGREED' ELSE 'DISAGREED' END AS status FROM a FULL JOIN b ON a.claim_id = b.claim_id)"""
SIDES = """WITH b AS (SELECT o_custkey AS deal, 'commit' AS step, o_orderkey AS pos, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
bn AS (SELECT *, row_number() OVER (PARTITION BY deal ORDER BY pos) AS nth FROM b),
sn AS (SELECT deal, step, CASE WHEN pos % 178 = 0 THEN 'X' ELSE status END AS status, CASE WHEN pos % 89 = 0 THEN 'other' ELSE priority END AS priority, row_number() OVER (PARTITION BY deal ORDER BY pos) AS nth FROM b WHERE pos % 97 <> 0),
f AS (SELECT coalesce(b.deal, s.deal) AS deal, coalesce(b.step, s.step) AS step, coalesce(b.nth, s.nth) AS nth, CASE WHEN s.deal IS NULL THEN 'missing_on_seller' WHEN b.deal IS NULL THEN 'missing_on_buyer' WHEN b.status <> s.status OR b.priority <> s.priority THEN 'differs' ELSE 'same' END AS finding,
  CASE WHEN s.deal IS NOT NULL AND b.deal IS NOT NULL AND (b.status <> s.status OR b.priority <> s.priority) THEN concat_ws(',', CASE WHEN b.status <> s.status THEN 'status' END, CASE WHEN b.priority <> s.priority THEN 'priority' END) END AS fields
  FROM bn b FULL JOIN sn s ON b.deal = s.deal AND b.nth = s.nth)"""
VERIFY = """WITH c AS (SELECT c_custkey AS id, c_name AS value, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'it is ' || c_name WHEN c_custkey % 7 = 0 THEN 'no' ELSE c_name END AS got, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS tier FROM customer),
o AS (SELECT id, tier, CASE WHEN got IS NULL THEN 'unanswered' WHEN got = value THEN 'faithful' WHEN contains(got, value) THEN 'contained' ELSE 'divergent' END AS outcome FROM c)"""
CITED = """WITH l AS (SELECT l_orderkey AS doc_id, CAST(l_suppkey AS VARCHAR) || CASE WHEN l_linenumber = 1 THEN ' Part ' ELSE ' Supp ' END || CAST(l_partkey AS VARCHAR) AS c FROM lineitem),
t AS (SELECT doc_id, string_agg(c, '; see ' ORDER BY c) AS text FROM l GROUP BY 1), x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+ [A-Z][a-z]+ [0-9]+')) AS cite FROM t)"""

ORACLE = {
    "rc_outer": CALLS + """, a AS (SELECT *, row_number() OVER (PARTITION BY session, req ORDER BY idx) AS nth FROM calls),
t AS (SELECT session, req, CASE WHEN event_id % 101 = 0 THEN 'altered' WHEN event_id % 103 = 0 THEN NULL ELSE resp END AS resp, row_number() OVER (PARTITION BY session, req ORDER BY idx) AS nth FROM calls WHERE event_id % 97 <> 0),
j AS (SELECT coalesce(a.session, t.session) AS session, CASE WHEN t.session IS NULL THEN 'missing_on_tool' WHEN a.session IS NULL THEN 'missing_on_agent' WHEN a.resp IS NOT DISTINCT FROM t.resp THEN 'matched' WHEN a.resp IS NULL OR t.resp IS NULL THEN 'missing_response' ELSE 'altered' END AS verdict
  FROM a FULL JOIN t ON a.session = t.session AND a.req = t.req AND a.nth = t.nth)
SELECT session, verdict, count(*) AS calls FROM j GROUP BY 1, 2""",
    "rc_gaps": CALLS + """, p AS (SELECT session, event_id AS pos, CASE WHEN event_id % 41 = 0 THEN idx + 3 WHEN event_id % 43 = 0 THEN greatest(idx - 2, 1) ELSE idx END AS idx FROM calls),
h AS (SELECT *, coalesce(max(idx) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS high, row_number() OVER (PARTITION BY session, idx ORDER BY pos) > 1 AS again FROM p),
f AS (SELECT session, pos, idx, CASE WHEN idx > high + 1 THEN 'gap' WHEN again THEN 'repeat' WHEN idx <= high THEN 'out_of_order' END AS finding FROM h) SELECT * FROM f WHERE finding IS NOT NULL""",
    "rc_headline": CALLS + """, f AS (SELECT session, CASE WHEN event_id % 2 = 0 THEN 'ALTERED' ELSE 'MISSING' END AS verdict, CASE WHEN event_id % 3 <> 0 THEN idx // 10 ELSE 0 END AS "at", CASE WHEN event_id % 5 < 2 THEN 'agent' ELSE 'tool' END AS side FROM calls),
r AS (SELECT *, rank() OVER (PARTITION BY session ORDER BY "at", verdict) AS k FROM f)
SELECT session, CAST(min("at") AS BIGINT) AS "at", min(verdict) AS verdict, CASE WHEN count(DISTINCT side) > 1 THEN 'both' ELSE min(side) END AS side FROM r WHERE k = 1 GROUP BY 1""",
    "rc_pins": CALLS + """, t AS (SELECT session, idx, md5(CAST(event_id AS VARCHAR)) AS chain FROM calls), n AS (SELECT session, max(idx) AS n FROM t GROUP BY 1),
p AS (SELECT session, CASE WHEN idx % 50 = 0 THEN idx + 40 ELSE idx END AS rows, chain FROM t WHERE idx % 25 = 0)
SELECT p.session, p.rows, CASE WHEN n.n < p.rows THEN 'short' WHEN t.chain = p.chain THEN 'agrees' ELSE 'differs' END AS finding FROM p JOIN n USING (session) LEFT JOIN t ON t.session = p.session AND t.idx = p.rows""",
    "gr_forks": EDGES + " SELECT old, claimant, last FROM members",
    "gr_resolved": EDGES + " SELECT old, min(id) AS resolver FROM cov WHERE len(hit) = n GROUP BY 1 HAVING count(*) = 1",
    "gr_conflicts": EDGES + """, s AS (SELECT old, hit, arg_min(id, pos) AS id, min(pos) AS pos FROM cov GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS k, first_value(id) OVER w AS f FROM s WINDOW w AS (PARTITION BY old ORDER BY pos, id)) SELECT old, f AS first, id AS second FROM r WHERE k > 1""",
    "rd_compare": RATERS + " SELECT claim_id, status FROM s",
    "rd_summary": RATERS + """ SELECT count(*) AS claims, count(*) FILTER (status = 'AGREED') AS agreed, count(*) FILTER (status = 'DISAGREED') AS disagreed, count(*) FILTER (status = 'MISSING') AS missing, count(*) FILTER (status LIKE 'COULD%') AS could_not_look,
  round(count(*) FILTER (status = 'AGREED') / CAST(count(*) FILTER (status IN ('AGREED', 'DISAGREED')) AS DOUBLE), 6) AS fraction, count(*) FILTER (status IN ('AGREED', 'DISAGREED')) < 20 AS not_yet_informative FROM s""",
    "rd_latest": "SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS claim_id, max(event_id) AS event_id, last(props ORDER BY event_id) AS props FROM events GROUP BY 1",
    "rd_citation_order": """WITH t AS (SELECT conv_id AS ledger, turn AS line, role, sha256(coalesce(text, '')) AS own FROM conversations),
c AS (SELECT t.ledger, t.line, t.role, CASE WHEN t.line % 3 = 1 THEN coalesce(p.own, t.own) ELSE t.own END AS sha FROM t LEFT JOIN t p ON p.ledger = t.ledger AND p.line = t.line - 1)
SELECT ledger, line, sha, exists(SELECT 1 FROM c k WHERE k.role = 'user' AND k.ledger = c.ledger AND k.sha = c.sha AND k.line < c.line) AS cited FROM c WHERE role <> 'user'""",
    "rd_parse": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'undetermined' END AS reading FROM documents",
    "dl_compare": SIDES + " SELECT deal, step, nth, finding, fields FROM f WHERE finding <> 'same'",
    "dl_dispute": SIDES + " SELECT deal, CASE WHEN bool_or(finding = 'differs') THEN 'DIFFERS' WHEN bool_or(finding LIKE 'missing%') THEN 'MISSING' ELSE 'AGREED' END AS verdict, count(*) FILTER (finding = 'differs') AS differing, count(*) FILTER (finding LIKE 'missing%') AS missing, count(*) AS rows FROM f GROUP BY 1",
    "dl_pin_bound": CALLS + """, p AS (SELECT session, idx AS rows, 't' || lpad(CAST(event_id * 7919 % 1000 AS VARCHAR), 4, '0') AS as_of FROM calls WHERE event_id % 17 = 0)
SELECT c.session AS party, c.idx AS n, min(p.as_of) AS bound FROM calls c LEFT JOIN p ON p.session = c.session AND p.rows >= c.idx GROUP BY 1, 2""",
    "dl_position": """WITH o AS (SELECT o_orderkey AS deal, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 100 AS BIGINT) * 60 END AS ship, CASE WHEN o_orderkey % 5 = 0 THEN 2430 END AS cancel FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0)
SELECT deal, CASE WHEN cancel IS NULL THEN 'not_cancelled' WHEN ship IS NULL THEN 'not_shipped' WHEN cancel < ship THEN 'cancelled_before_ship' ELSE 'cancelled_after_ship' END AS position, CAST(round_even((ship - cancel) / 60.0, 0) AS BIGINT) AS minutes FROM o""",
    "hs_verify": """WITH p AS (SELECT o_custkey AS id, last(CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END ORDER BY o_orderkey) AS terms, max(o_orderkey) AS row FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1),
a AS (SELECT o_custkey AS id, last(CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE o_orderpriority END ORDER BY o_orderkey) AS terms, last(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1 ELSE o_orderkey END ORDER BY o_orderkey) AS cited FROM orders WHERE o_orderkey % 11 <> 1 GROUP BY 1)
SELECT coalesce(p.id, a.id) AS id, CASE WHEN p.id IS NULL OR a.id IS NULL THEN 'MISSING' WHEN p.terms IS NULL OR a.terms IS NULL THEN 'COULD_NOT_LOOK' WHEN p.terms <> a.terms THEN 'DIFFERENT_TERMS' WHEN p.row IS DISTINCT FROM a.cited THEN 'COULD_NOT_LOOK' ELSE 'AGREED_TERMS' END AS verdict FROM p FULL JOIN a ON p.id = a.id""",
    "ct_diff": "SELECT p_partkey AS id, CASE WHEN p_partkey % 19 = 0 THEN 'removed' ELSE 'changed' END AS change FROM part WHERE p_partkey % 19 = 0 OR p_partkey % 23 = 0 UNION ALL SELECT p_partkey + 1000000, 'added' FROM part WHERE p_partkey % 29 = 0",
    "ct_added": "SELECT p_brand AS field, string_agg(p_name || '-' || p_partkey, ',' ORDER BY p_name || '-' || p_partkey) AS ids FROM part WHERE p_partkey % 31 = 0 GROUP BY 1",
    "ct_restate": """WITH n AS (SELECT CAST(n_regionkey AS VARCHAR) AS f, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation)
SELECT CASE WHEN c = 1 THEN f ELSE f || '#' || i END AS id, n_name AS value FROM n UNION ALL SELECT 'only', n_name FROM nation WHERE n_nationkey = 3""",
    "ct_verify": VERIFY + " SELECT id, outcome, CASE WHEN outcome = 'divergent' THEN coalesce(tier, 'notable') END AS severity FROM o",
    "ct_curve": VERIFY + """, g AS (SELECT id, 'D' || (id % 6) AS grade, outcome = 'faithful' AS f, id % 4 <> 0 AS e FROM o)
SELECT grade, count(*) AS n, round(avg(CAST(f AS INT)), 4) AS faithful_rate, round(avg(CAST(f = e AS INT)), 4) AS agreement, min(id) FILTER (f <> e) AS first_disagreeing FROM g GROUP BY 1""",
    "gd_drift": """WITH p AS (SELECT DISTINCT p_name AS item FROM part)
SELECT item, CASE WHEN length(item) % 5 = 0 THEN 'new' WHEN regexp_matches(item, '[aeo]{2}|st') AND NOT regexp_matches(item, '[aeiou]{2}') THEN 'gained' WHEN NOT regexp_matches(item, '[aeo]{2}|st') AND regexp_matches(item, '[aeiou]{2}') THEN 'lost' ELSE 'same' END AS change FROM p""",
    "gd_accept": "SELECT DISTINCT p_name AS item FROM part WHERE regexp_matches(p_name, '[aeo]{2}')",
    "ci_extract": CITED + " SELECT doc_id, cite FROM x",
    "ci_unrecognized": CITED + " SELECT doc_id, cite FROM x WHERE NOT exists(SELECT 1 FROM x y WHERE y.doc_id = x.doc_id AND y.cite = x.cite AND length(y.cite) % 4 <> 0)",
    "ci_summary": CITED + " SELECT CASE WHEN length(cite) % 4 = 0 THEN 'flagged' WHEN length(cite) % 4 = 1 THEN 'not_checked' ELSE 'ok' END AS status, count(*) AS n, min(cite) AS first FROM x GROUP BY 1",
}
