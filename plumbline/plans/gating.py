"""Queries on mandates, sessions, usage look-ups, status roll-ups and edit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.fold import ordered_fold
from plumbline.operators import gates
from plumbline.session import table

ALLOW, DENY, CAP, TOTAL = ["cl*", "view", "p?rch[a-z]se"], ["clo*", "[!a-z]*"], "300.00", 900
START, END = "2024-01-03 00:00:00", "2024-01-28 12:00:00"

# ---- fixtures


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    amount = F.when(F.col("event_id") % 29 == 0, "n/a").otherwise(F.format_string("%.2f", "value"))
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), amount.alias("amount"), "ts")


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate(tool_calls(spark, sf_dir), ALLOW, DENY, CAP, START, END)


def session_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each session that ended: how many of its calls were inside."""
    g = gated(spark, sf_dir).where("session % 9 <> 0")
    return g.groupBy("session").agg(F.count_if(F.col("reason") == "inside").alias("inside"), F.count_if(F.col("reason") != "inside").alias("blocked"), F.max("seq").alias("line"))


def hashed_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(key.alias("key"), F.sha2(key, 256).alias("hash"), F.col("c_mktsegment").alias("plan"))


def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("key"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("used"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "paste").when(F.col("event_type") == "error", "delete").otherwise("type")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), F.length("props").cast("long").alias("chars"), "ts")


# ---- queries


def md_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).select("session", "seq", "reason")


def md_session_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.session_spend(gated(spark, sf_dir), TOTAL)


def md_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict counters of each session; forwarded spend counts, blocked spend doesn't."""
    s = gates.session_spend(gated(spark, sf_dir), TOTAL)
    return s.groupBy("session").agg(F.count_if(F.col("verdict") == "forwarded").alias("forwarded"), F.count_if(F.col("verdict") != "forwarded").alias("blocked"), F.max("spent").alias("spent"))


def md_last_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.last_session(gated(spark, sf_dir), "session", "seq").groupBy("reason").agg(F.count("*").alias("calls"))


def md_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).agg(F.countDistinct("session").alias("sessions"), F.count_if(F.col("reason") == "inside").alias("inside"))


def md_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.when(k % 7 == 0, "-1").when(k % 11 == 0, "1e").when(k % 13 != 0, F.format_string("%.2f", "o_totalprice")).alias("cap"),
        F.when(k % 5 == 0, F.substring("o_orderpriority", 1, 3)).otherwise("EUR").alias("currency"),
        F.when(k % 17 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("not_before"),
        F.when(k % 19 == 0, "1990-01-01").when(k % 23 == 0, "never").otherwise("2030-01-01").alias("not_after"),
    )
    return gates.lint_mandate(o).where("problems <> ''")


def ag_mandate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = session_ends(spark, sf_dir).withColumn("mode", F.when(F.col("session") % 2 == 0, "enforce").otherwise("record"))
    return gates.mandate_totals(ends.withColumnRenamed("inside", "allowed"))


def ev_mandate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gated(spark, sf_dir).select("session", F.when(F.col("reason") == "unreadable_amount", "could_not_look").when(F.col("reason") == "inside", "inside").otherwise("outside").alias("verdict"))
    return gates.windowed_counts(session_ends(spark, sf_dir), g)


def ev_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way verdict counts a session, kept as three columns."""
    r = F.col("reason")
    return gated(spark, sf_dir).groupBy("session").agg(F.count_if(r == "inside").alias("good"), F.count_if(~r.isin("inside", "unreadable_amount")).alias("bad"), F.count_if(r == "unreadable_amount").alias("could_not_look"))


def ev_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest stamp of each session that can be read."""
    text = F.when(F.col("seq") % 3 == 0, "later").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return tool_calls(spark, sf_dir).groupBy("session").agg(F.date_format(F.max(F.try_to_timestamp(text)), "yyyy-MM-dd HH:mm:ss").alias("newest"), F.count_if(F.try_to_timestamp(text).isNull()).alias("unreadable"))


def ag_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct targets checked on one day, by outcome."""
    return gated(spark, sf_dir).where(F.to_date("ts") == F.lit("2024-01-15").cast("date")).groupBy("reason").agg(F.countDistinct("session").alias("targets"), F.count("*").alias("checks"))


def ag_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.when(F.col("o_orderkey") % 4 != 0, F.round("o_totalprice").cast("long")).alias("cost"))
    month = "1995-03"
    return gates.ceiling(c, month, 1000000.0).unionAll(gates.ceiling(c, "2050-01", 1.0))


def ag_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts a cohort by verdict, with a score from the first field that has one (an explicit blank counts)."""
    o = table(spark, sf_dir, "orders")
    score = F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 5 == 0, F.lit("")), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderstatus")), F.lit("none"))
    return o.select(F.col("o_custkey").alias("cohort"), F.col("o_orderstatus").alias("verdict"), score.alias("score")).groupBy("cohort", "verdict").agg(F.count("*").alias("n"), F.countDistinct("score").alias("scores"), F.min("score").alias("least"))


def ag_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a cohort by pages of 20 in order."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cohort"), F.floor(k / gates.PAGE).alias("page"), "o_orderkey").groupBy("cohort", "page").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def ag_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3 != 0).alias("is_latest"), F.when(F.col("p_size") < 40, "active").otherwise("gone").alias("status"))
    return gates.first_active(p, "name", "id").select("name", "id")


def ag_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 7 == 0, False).when(k % 7 != 1, True).alias("ok"), F.when(k % 5 == 0, "rewritten").when(k % 5 == 1, "no_record").when(k % 11 != 0, "consistent").alias("w"))
    return c.select("id", gates.chain_and_witness(F.col("ok"), F.col("w")).alias("finding"))


def mt_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, r = used(spark, sf_dir), hashed_roster(spark, sf_dir)
    asked = ["ef2d127de3", "ef2d", "ffffffffff"]  # the first hash is that of key 5
    parts = [gates.usage_of(u, r, p).withColumn("asked", F.lit(p)) for p in asked]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def mt_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows under a legacy prefix."""
    return used(spark, sf_dir).where(F.col("key").startswith("1")).select("month", "key", "used")


def mt_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed_roster(spark, sf_dir).select(F.substring("hash", 1, 12).alias("short"), "plan", "key").orderBy("short")


def au_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return gates.typed_totals(edits(spark, sf_dir)).withColumns({"first": text("first"), "last": text("last")})


def au_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling hash at every 20th event of a session (of 500 in production) and at its end."""
    import hashlib

    from pyspark.sql import types as T

    rows = edits(spark, sf_dir).select("session", "seq", F.concat_ws("|", "kind", F.col("chars").cast("string")).alias("body"))

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        now = (hashlib.sha256((state[0] + row["body"]).encode()).hexdigest(), state[1] + 1)
        return now, now

    added = T.StructType([T.StructField("rolling", T.StringType()), T.StructField("n", T.LongType())])
    folded = ordered_fold(rows, ["session"], ["seq"], lambda: ("genesis", 0), step, added)
    return folded.where("n % 20 = 0").select("session", "n", "rolling")


def pi_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("+49 (0)"), (k * 1237).cast("string"))).when(k % 3 == 1, F.col("c_name")).otherwise(k.cast("string"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name")).where(gates.looks_like_phone(F.col("name")))


def pi_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_shipdate")).otherwise(F.col("o_orderdate"))
    end = F.when(F.col("l_linenumber") % 3 == 0, F.col("o_orderdate")).otherwise(F.col("l_shipdate"))
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), gates.duration(start, end).alias("seconds"))


def tx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" \r\n"), F.regexp_replace("text", "\\. ", ".\r"), F.lit("\r")).alias("t"))
    return d.select("doc_id", gates.plain_lines(F.col("t")).alias("plain")).select("doc_id", F.length("plain").cast("long").alias("n_chars"), F.md5("plain").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (md_gate, md_session_spend, md_counters, md_last_session, md_sessions, md_lint, ag_mandate, ev_mandate, ev_counts, ev_newest, ag_today, ag_ceiling, ag_cohort, ag_pages, ag_population, ag_finding, mt_usage, mt_prefix, mt_list, au_totals, au_checkpoints, pi_phone, pi_duration, tx_lines)
}

# ---- SQL

GATED = """WITH RECURSIVE c AS (SELECT user_id AS session, event_id AS seq, event_type AS tool, CASE WHEN event_id % 29 = 0 THEN 'n/a' ELSE printf('%.2f', value) END AS amount, ts FROM events),
g AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-03 00:00:00' THEN 'before_window' WHEN ts > TIMESTAMP '2024-01-28 12:00:00' THEN 'after_window' WHEN regexp_full_match(tool, 'clo.*|[^a-z].*') THEN 'denied'
  WHEN NOT regexp_full_match(tool, 'cl.*|view|p.rch[a-z]se') THEN 'not_allowed' WHEN TRY_CAST(amount AS DECIMAL(38,2)) IS NULL THEN 'unreadable_amount' WHEN CAST(amount AS DECIMAL(38,2)) > 300 THEN 'over_cap' ELSE 'inside' END AS reason FROM c)"""
SPEND = """, n AS (SELECT session, seq, reason, CASE WHEN reason = 'inside' THEN CAST(CAST(amount AS DECIMAL(38,2)) * 100 AS BIGINT) ELSE 0 END AS cents, row_number() OVER (PARTITION BY session ORDER BY seq) AS k FROM g),
f AS (SELECT session, seq, k, CASE WHEN reason <> 'inside' THEN reason WHEN cents <= 90000 THEN 'forwarded' ELSE 'over_total' END AS verdict, CASE WHEN cents <= 90000 THEN cents ELSE 0 END AS spent FROM n WHERE k = 1
  UNION ALL SELECT n.session, n.seq, n.k, CASE WHEN n.reason <> 'inside' THEN n.reason WHEN f.spent + n.cents <= 90000 THEN 'forwarded' ELSE 'over_total' END, CASE WHEN f.spent + n.cents <= 90000 THEN f.spent + n.cents ELSE f.spent END FROM n JOIN f ON n.session = f.session AND n.k = f.k + 1)"""
ENDS = """, ends AS (SELECT session, count(*) FILTER (reason = 'inside') AS inside, count(*) FILTER (reason <> 'inside') AS blocked, max(seq) AS line FROM g WHERE session % 9 <> 0 GROUP BY 1)"""
EDITS = "edits AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'paste' WHEN 'error' THEN 'delete' ELSE 'type' END AS kind, length(props) AS chars, ts FROM events)"
USED = "u AS (SELECT CAST(user_id AS VARCHAR) AS key, strftime(ts, '%Y-%m') AS month, count(*) AS used FROM events GROUP BY 1, 2), r AS (SELECT CAST(c_custkey AS VARCHAR) AS key, sha256(CAST(c_custkey AS VARCHAR)) AS hash, c_mktsegment AS plan FROM customer)"

ORACLE = {
    "md_gate": GATED + " SELECT session, seq, reason FROM g",
    "md_session_spend": GATED + SPEND + " SELECT session, seq, verdict, spent FROM f",
    "md_counters": GATED + SPEND + " SELECT session, count(*) FILTER (verdict = 'forwarded') AS forwarded, count(*) FILTER (verdict <> 'forwarded') AS blocked, max(spent) AS spent FROM f GROUP BY 1",
    "md_last_session": GATED + " SELECT reason, count(*) AS calls FROM g WHERE session = (SELECT arg_max(session, seq) FROM g) GROUP BY 1",
    "md_sessions": GATED + " SELECT count(DISTINCT session) AS sessions, count(*) FILTER (reason = 'inside') AS inside FROM g",
    "md_lint": """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN '-1' WHEN o_orderkey % 11 = 0 THEN '1e' WHEN o_orderkey % 13 <> 0 THEN printf('%.2f', o_totalprice) END AS cap, CASE WHEN o_orderkey % 5 = 0 THEN substr(o_orderpriority, 1, 3) ELSE 'EUR' END AS cur,
  o_orderkey % 17 = 0 AS nb, CASE WHEN o_orderkey % 19 = 0 THEN 'e' WHEN o_orderkey % 23 = 0 THEN 'n' END AS na, o_orderdate AS d FROM orders),
p AS (SELECT id, concat_ws(',', CASE WHEN cap = '1e' THEN 'cap_unreadable' WHEN TRY_CAST(cap AS DECIMAL(30,2)) < 0 THEN 'cap_negative' END, CASE WHEN NOT regexp_full_match(cur, '[A-Z]{3}') THEN 'currency' END, CASE WHEN nb THEN 'not_before_unreadable' END,
  CASE WHEN na = 'n' THEN 'not_after_unreadable' WHEN na = 'e' AND NOT nb AND d >= TIMESTAMP '1990-01-02' THEN 'window_empty' END) AS problems FROM o) SELECT * FROM p WHERE problems <> ''""",
    "ag_mandate": GATED + ENDS + " SELECT CASE WHEN session % 2 = 0 THEN 'enforce' ELSE 'record' END AS mode, count(DISTINCT session) AS sessions, sum(inside) AS allowed, sum(blocked) AS blocked, arg_max(session, line) AS newest FROM ends GROUP BY 1",
    "ev_mandate": GATED + ENDS + " SELECT (SELECT coalesce(sum(inside), 0) FROM ends) AS inside, count(*) FILTER (reason NOT IN ('inside', 'unreadable_amount')) AS outside, count(*) FILTER (reason = 'unreadable_amount') AS could_not_look, count(DISTINCT session) - (SELECT count(*) FROM ends) AS unended FROM g",
    "ev_counts": GATED + " SELECT session, count(*) FILTER (reason = 'inside') AS good, count(*) FILTER (reason NOT IN ('inside', 'unreadable_amount')) AS bad, count(*) FILTER (reason = 'unreadable_amount') AS could_not_look FROM g GROUP BY 1",
    "ev_newest": "SELECT user_id AS session, strftime(date_trunc('second', max(ts) FILTER (event_id % 3 <> 0)), '%Y-%m-%d %H:%M:%S') AS newest, count(*) FILTER (event_id % 3 = 0) AS unreadable FROM events GROUP BY 1",
    "ag_today": GATED + " SELECT reason, count(DISTINCT session) AS targets, count(*) AS checks FROM g WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1",
    "ag_ceiling": """WITH c AS (SELECT CASE WHEN o_orderkey % 4 <> 0 THEN CAST(round(o_totalprice) AS BIGINT) END AS cost FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1995-03')
SELECT count(*) AS pins, count(*) FILTER (cost > 0) AS billable, sum(cost) AS total, round(sum(cost) / 1000000.0 * 100, 2) AS pct, CASE WHEN sum(cost) IS NULL THEN 'absent' WHEN sum(cost) >= 1000000 THEN 'red' WHEN sum(cost) >= 800000 THEN 'warn' ELSE 'ok' END AS level FROM c
UNION ALL SELECT 0, 0, NULL, NULL, 'absent'""",
    "ag_cohort": """WITH o AS (SELECT o_custkey AS cohort, o_orderstatus AS verdict, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN o_orderstatus ELSE 'none' END AS score FROM orders)
SELECT cohort, verdict, count(*) AS n, count(DISTINCT score) AS scores, min(score) AS least FROM o GROUP BY 1, 2""",
    "ag_pages": "WITH k AS (SELECT o_custkey AS cohort, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 20 AS page FROM orders) SELECT cohort, page, count(*) AS n, min(o_orderkey) AS first FROM k GROUP BY 1, 2",
    "ag_population": "SELECT p_name AS name, min(p_partkey) AS id FROM part WHERE p_partkey % 3 <> 0 AND p_size < 40 GROUP BY 1",
    "ag_finding": """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'damaged' WHEN c_custkey % 5 = 0 THEN 'rewritten' WHEN c_custkey % 7 = 1 OR c_custkey % 5 = 1 OR c_custkey % 11 = 0 THEN 'could_not_look' ELSE 'consistent' END AS finding FROM customer""",
    "mt_usage": "WITH " + USED + ", a AS (SELECT unnest(['ef2d127de3', 'ef2d', 'ffffffffff']) AS asked), m AS (SELECT a.asked, count(r.key) AS n, min(r.key) AS key FROM a LEFT JOIN r ON starts_with(r.hash, a.asked) GROUP BY 1), e AS (SELECT *, CASE WHEN length(asked) < 6 THEN 'prefix_too_short' WHEN n = 0 THEN 'unknown' WHEN n > 1 THEN 'ambiguous' END AS error FROM m) SELECT e.key, month, used, error, asked FROM e JOIN u ON u.key = e.key WHERE error IS NULL UNION ALL SELECT NULL, NULL, NULL, error, asked FROM e WHERE error IS NOT NULL",
    "mt_prefix": "WITH " + USED + " SELECT month, key, used FROM u WHERE starts_with(key, '1')",
    "mt_list": "WITH " + USED + " SELECT substr(hash, 1, 12) AS short, plan, key FROM r ORDER BY 1",
    "au_totals": "WITH " + EDITS + """ SELECT session, CAST(coalesce(sum(chars) FILTER (kind = 'type'), 0) AS BIGINT) AS typed, CAST(coalesce(sum(chars) FILTER (kind = 'paste'), 0) AS BIGINT) AS pasted, CAST(coalesce(sum(chars) FILTER (kind = 'delete'), 0) AS BIGINT) AS deleted, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS first, strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS last,
  round(coalesce(sum(chars) FILTER (kind = 'paste'), 0) / CAST(nullif(sum(chars) FILTER (kind <> 'delete'), 0) AS DOUBLE), 3) AS pasted_share FROM edits GROUP BY 1""",
    "au_checkpoints": "WITH RECURSIVE " + EDITS + """, n AS (SELECT session, kind || '|' || chars AS body, row_number() OVER (PARTITION BY session ORDER BY seq) AS n FROM edits),
f AS (SELECT session, n, sha256('genesis' || body) AS rolling FROM n WHERE n = 1 UNION ALL SELECT n.session, n.n, sha256(f.rolling || n.body) FROM n JOIN f ON n.session = f.session AND n.n = f.n + 1) SELECT session, n, rolling FROM f WHERE n % 20 = 0""",
    "pi_phone": r"""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '+49 (0)' || (c_custkey * 1237) WHEN c_custkey % 3 = 1 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS name FROM customer) SELECT * FROM c WHERE regexp_full_match(name, '\+?[\d\-.\s()]{7,}')""",
    "pi_duration": """WITH j AS (SELECT l_orderkey AS id, l_linenumber AS n, date_diff('microsecond', o_orderdate, l_shipdate) * CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT id, n, CASE WHEN d >= 0 THEN d / 1e6 END AS seconds FROM j""",
    "tx_lines": r"""WITH d AS (SELECT doc_id, ' ' || chr(13) || chr(10) || replace(text, '. ', '.' || chr(13)) || chr(13) AS t FROM documents),
p AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^[ \t\n]+', ''), '[ \t\n]+$', '') AS plain FROM d) SELECT doc_id, length(plain) AS n_chars, md5(plain) AS digest FROM p""",
}
