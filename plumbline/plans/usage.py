"""Queries on usage, logs and texts: metering, roll-ups, mandates, pairing, text measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import textual
from plumbline.operators import metering, reports
from plumbline.session import table

PLAN_CAPS = {"free": 30, "pro": None}
CODES, SINCE, UNTIL = ["click", "view", "purchase", "none"], "2024-01-05 00:00:00", "2024-02-20 12:00:00"

# ---- fixtures


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.date_format("ts", "yyyy-MM").alias("month"), F.col("event_id").alias("seq"), (1 + F.col("event_id") % 3).alias("cost"))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    plan = F.when(c % 3 == 0, "free").when(c % 3 == 1, "pro").otherwise("odd")
    cap = F.when(c % 8 == 2, -1).when(c % 8 != 1, c % 40).cast("long")
    return table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(c.cast("string").alias("key"), plan.alias("plan"), (c % 4 != 0).alias("has_cap"), cap.alias("cap"))


def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("key", "month").agg(F.sum("cost").alias("used"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    text = F.when(i % 31 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select(i.alias("line"), F.col("user_id").alias("target"), F.when(i % 17 != 0, F.col("event_type")).alias("event"), text.alias("ts"), (i % 4).cast("int").alias("code"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), (i % 3).alias("id"), i.alias("pos"), F.when(i % 5 < 2, "answer").otherwise("call").alias("kind"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of a conversation as pairs of normalized texts."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", textual.normalized(F.col("text")).alias("x"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return c.join(after, ["conv_id", "turn"])


# ---- queries


def mt_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metering.caps(roster(spark, sf_dir), PLAN_CAPS)


def mt_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metering.grants(calls(spark, sf_dir), mt_caps(spark, sf_dir))
    return found.groupBy("key", "month").agg(F.count("*").alias("calls"), F.count_if("granted").alias("granted"), F.max("used").alias("used"))


def mt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metering.usage_report(roster(spark, sf_dir), used(spark, sf_dir))


def mt_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metering.orphans(roster(spark, sf_dir), used(spark, sf_dir))


def mt_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = used(spark, sf_dir).select(F.substring("key", 1, 2).alias("key"), "used")
    return metering.migrate(short, roster(spark, sf_dir), 2)


def mt_revoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = roster(spark, sf_dir).select(F.md5("key").alias("key"), (F.col("cap") == 7).alias("revoked")).na.fill(False)
    return metering.revoke(keys, "c4ca42")


def ag_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary(log(spark, sf_dir))


def ag_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.still_open(log(spark, sf_dir), 3)


def on_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).select(F.concat_ws("/", F.col("target").cast("string"), "code").alias("key"), "line", F.when(F.col("line") % 3 == 0, "intent").otherwise("executed").alias("kind"))
    return reports.latest_states(rows)


def on_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_claims(log(spark, sf_dir).select(F.col("target").alias("key"), "line"))


def bl_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return reports.scores(table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("?")).alias("type"), F.when(i % 7 != 0, (i % 5) / 4.0).alias("score")))


def ag_pctl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.nearest_rank(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", 0.95)


def ag_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("event_id") % 7 == 0).alias("k"), F.count("*").alias("n"))
    low, high = reports.wilson(F.col("k"), F.col("n"))
    return k.select("event_type", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def ag_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bucket_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("bucket")), spark.createDataFrame([(c,) for c in CODES], "bucket string"))


def ag_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("s"))
    return o.groupBy("o_custkey").agg(reports.one_of(F.col("s")).alias("status"), F.count("*").alias("n"))


def ax_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.md5(F.col("l_partkey").cast("string")).alias("digest"), F.col("l_orderkey").alias("call"), F.col("l_linestatus").alias("tool"))
    return reports.access_register(e)


def md_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    terms = o.select(
        k.alias("id"),
        F.when(k % 7 == 0, "b").otherwise("a").alias("merchant"),
        F.lit("a").alias("allowed_merchant"),
        F.when(k % 11 == 0, "EUR").otherwise("USD").alias("currency"),
        F.lit("USD").alias("allowed_currency"),
        F.when(k % 13 == 0, "NaN").otherwise((k % 500).cast("string")).alias("amount"),
        F.lit(400).alias("cap"),
        F.when(k % 17 == 0, "later").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("at"),
        F.lit("1994-01-01").cast("timestamp").alias("not_before"),
        F.lit("1996-12-31").cast("timestamp").alias("not_after"),
    )
    return reports.mandate_check(terms)


def sm_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pairs(frames(spark, sf_dir))


def sm_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm_pairs(spark, sf_dir).where("answer is null").select("scope", "id", "call")


def ev_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.in_window(log(spark, sf_dir), SINCE, UNTIL).groupBy("placed").agg(F.count("*").alias("n"), F.min("line").alias("first"))


def dd_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(textual.normalized(F.coalesce("text", F.lit("")))).alias("digest"))


def dd_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(textual.normalized(F.coalesce("text", F.lit(""))), 256).alias("k"))
    return d.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def dd_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(textual.overlap(F.col("x"), F.col("y")), 6).alias("overlap"))


def dd_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.bit_count(k.bitwiseXOR(F.col("o_custkey"))).cast("long").alias("bits"))


def ds_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", textual.token_estimate(F.col("text")).alias("tokens"))


def ds_headtail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textual.head_and_tail(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 7)


def cp_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items dropped and introduced between two multisets, with their bytes."""
    p = table(spark, sf_dir, "part")
    before = p.select(F.col("p_type").alias("item"))
    after = p.where("p_partkey % 4 <> 0").select(F.when(F.col("p_partkey") % 9 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("item"))
    side = lambda a, b, name: a.exceptAll(b).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("bytes")).withColumn("side", F.lit(name))
    return side(before, after, "dropped").unionByName(side(after, before, "introduced"))


def vt_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textual.entropy(table(spark, sf_dir, "part"), "p_partkey", "p_name")


def vt_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", *[F.size(F.regexp_extract_all("text", F.lit(f"({p})"), 1)).cast("long").alias(n) for n, p in textual.SECRETS.items()])


def ax_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", textual.url_name(F.concat("url", F.lit("?q=1#top"))).alias("name"))


QUERIES = {
    f.__name__: f
    for f in (mt_caps, mt_grants, mt_export, mt_orphans, mt_migrate, mt_revoke, ag_audit_summary, ag_status, on_state, on_first, bl_aggregate, ag_pctl, ag_wilson, ag_buckets, ag_roster, ax_register, md_check, sm_pairs, sm_unanswered, ev_window, dd_normalize, dd_exact, dd_overlap, dd_hamming, ds_tokens, ds_headtail, cp_drops, vt_entropy, vt_secrets, ax_urls)
}

# ---- SQL

CALLS = "calls AS (SELECT CAST(user_id AS VARCHAR) AS key, strftime(ts, '%Y-%m') AS month, event_id AS seq, 1 + event_id % 3 AS cost FROM events)"
ROSTER = """roster AS (SELECT CAST(c_custkey AS VARCHAR) AS key, CASE c_custkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'odd' END AS plan, c_custkey % 4 <> 0 AS has_cap,
  CASE WHEN c_custkey % 8 = 2 THEN -1 WHEN c_custkey % 8 <> 1 THEN c_custkey % 40 END AS cap FROM customer WHERE c_custkey % 5 <> 0)"""
CAPS = """caps AS (SELECT key, CASE WHEN has_cap THEN cap IS NULL ELSE plan = 'pro' END AS unlimited,
  CAST(CASE WHEN has_cap THEN greatest(coalesce(cap, 0), 0) WHEN plan = 'free' THEN 30 ELSE 0 END AS BIGINT) AS cap FROM roster)"""
USED = "used AS (SELECT key, month, CAST(sum(cost) AS BIGINT) AS used FROM calls GROUP BY 1, 2)"
LOG = "log AS (SELECT event_id AS line, user_id AS target, CASE WHEN event_id % 17 <> 0 THEN event_type END AS event, CASE WHEN event_id % 31 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts, event_id % 4 AS code FROM events)"
PAIRS = """f AS (SELECT user_id AS scope, event_id % 3 AS id, event_id AS pos, CASE WHEN event_id % 5 < 2 THEN 'answer' ELSE 'call' END AS kind FROM events),
d AS (SELECT *, sum(CASE WHEN kind = 'call' THEN 1 ELSE -1 END) OVER (PARTITION BY scope, id ORDER BY pos) AS depth FROM f),
l AS (SELECT *, min(least(depth, 0)) OVER (PARTITION BY scope, id ORDER BY pos) AS low FROM d),
s AS (SELECT *, kind = 'answer' AND low < coalesce(lag(low) OVER (PARTITION BY scope, id ORDER BY pos), 0) AS stray FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY scope, id, kind ORDER BY pos) AS nth FROM s WHERE NOT stray),
pairs AS (SELECT c.scope, c.id, c.pos AS call, a.pos AS answer FROM k c LEFT JOIN k a ON a.kind = 'answer' AND a.scope = c.scope AND a.id = c.id AND a.nth = c.nth WHERE c.kind = 'call')"""
NORM = "array_to_string(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\p{L}\\p{N}_]+'), ' ')"

ORACLE = {
    "mt_caps": f"WITH {ROSTER}, {CAPS} SELECT * FROM caps",
    "mt_grants": f"""WITH RECURSIVE {CALLS}, {ROSTER}, {CAPS}, o AS (SELECT c.key, month, seq, cost, coalesce(unlimited, false) AS u, coalesce(cap, 0) AS cap, row_number() OVER (PARTITION BY c.key, month ORDER BY seq) AS k FROM calls c LEFT JOIN caps USING (key)),
f AS (SELECT key, month, k, u OR cost <= cap AS g, CASE WHEN u OR cost <= cap THEN cost ELSE 0 END AS used FROM o WHERE k = 1
  UNION ALL SELECT o.key, o.month, o.k, o.u OR f.used + o.cost <= o.cap, f.used + CASE WHEN o.u OR f.used + o.cost <= o.cap THEN o.cost ELSE 0 END FROM f JOIN o ON o.key = f.key AND o.month = f.month AND o.k = f.k + 1)
SELECT key, month, count(*) AS calls, count(*) FILTER (g) AS granted, max(used) AS used FROM f GROUP BY 1, 2""",
    "mt_export": f"WITH {CALLS}, {ROSTER}, {USED} SELECT key, plan, CAST(coalesce(sum(used), 0) AS BIGINT) AS used FROM roster LEFT JOIN used USING (key) GROUP BY 1, 2",
    "mt_orphans": f"WITH {CALLS}, {ROSTER}, {USED} SELECT count(*) AS rows, CAST(coalesce(sum(used), 0) AS BIGINT) AS used FROM used WHERE key NOT IN (SELECT key FROM roster)",
    "mt_migrate": f"""WITH {CALLS}, {ROSTER}, {USED}, own AS (SELECT substr(key, 1, 2) AS short, min(key) AS owner FROM roster GROUP BY 1 HAVING count(*) = 1)
SELECT coalesce(owner, 'legacy:' || substr(key, 1, 2)) AS key, CAST(sum(used) AS BIGINT) AS used FROM used LEFT JOIN own ON short = substr(key, 1, 2) GROUP BY 1""",
    "mt_revoke": f"WITH {ROSTER} SELECT md5(key) AS key, coalesce(cap = 7, false) OR (md5(key) LIKE 'c4ca42%' AND (SELECT count(*) FROM roster WHERE md5(key) LIKE 'c4ca42%') = 1) AS revoked FROM roster",
    "ag_audit_summary": f"WITH {LOG} SELECT coalesce(event, '?') AS event, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM log GROUP BY 1",
    "ag_status": f"WITH {LOG} SELECT target, max(line) AS line FROM log GROUP BY 1 HAVING arg_max(code, line) = 3",
    "on_state": f"""WITH {LOG}, m AS (SELECT CAST(target AS VARCHAR) || '/' || code AS key, max(line) FILTER (line % 3 = 0) AS intent, max(line) FILTER (line % 3 <> 0) AS executed FROM log GROUP BY 1)
SELECT key, CASE WHEN executed > coalesce(intent, -1) THEN 'executed' ELSE 'intent' END AS state, intent, CASE WHEN executed > coalesce(intent, -1) THEN executed END AS executed FROM m""",
    "on_first": "SELECT user_id AS key, min(event_id) AS line FROM events GROUP BY 1",
    "bl_aggregate": """WITH i AS (SELECT coalesce(lang, '?') AS type, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 5) / 4.0::DOUBLE END AS score FROM documents)
SELECT CASE WHEN grouping(type) = 1 THEN '(all)' ELSE type END AS type, count(*) AS n, count(score) AS n_scored, sum(score) AS sum, round(avg(score), 6) AS mean FROM i GROUP BY GROUPING SETS ((type), ())""".replace("GROUP BY GROUPING SETS ((type), ())", "GROUP BY GROUPING SETS ((i.type), ())").replace("grouping(type)", "grouping(i.type)").replace("ELSE type END", "ELSE i.type END"),
    "ag_pctl": "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.95) AS pctl FROM lineitem GROUP BY 1",
    "ag_wilson": """WITH c AS (SELECT event_type, count(*) FILTER (event_id % 7 = 0) AS k, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, k / CAST(n AS DOUBLE) AS p, 1.959964::DOUBLE AS z FROM c)
SELECT event_type, k, n, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 6) AS low,
  round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 6) AS high FROM p""",
    "ag_buckets": "SELECT b AS bucket, count(event_id) AS n FROM (VALUES " + ", ".join(f"('{c}')" for c in CODES) + ") t(b) LEFT JOIN events ON event_type = b GROUP BY 1",
    "ag_roster": """WITH g AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus) FILTER (o_orderstatus <> 'P')) AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN s IS NULL OR len(s) = 0 THEN 'none' WHEN len(s) = 1 THEN s[1] ELSE '(mixed) ' || array_to_string(s, '; ') END AS status, n FROM g""",
    "ax_register": "SELECT l_returnflag AS kind, md5(CAST(l_partkey AS VARCHAR)) AS digest, count(DISTINCT l_orderkey) AS calls, min(l_orderkey) AS first_call, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS tools FROM lineitem GROUP BY 1, 2",
    "md_check": """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'merchant' WHEN o_orderkey % 11 = 0 THEN 'currency' WHEN o_orderkey % 13 = 0 THEN 'amount_unreadable' WHEN o_orderkey % 500 > 400 THEN 'cap' WHEN o_orderkey % 17 = 0 THEN 'time_unreadable'
  WHEN date_trunc('second', o_orderdate) < TIMESTAMP '1994-01-01' OR date_trunc('second', o_orderdate) > TIMESTAMP '1996-12-31' THEN 'window' ELSE 'ok' END AS reason FROM orders)
SELECT id, CASE WHEN reason = 'ok' THEN true WHEN reason LIKE '%unreadable' THEN NULL ELSE false END AS ok, reason FROM r""",
    "sm_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
    "sm_unanswered": f"WITH {PAIRS} SELECT scope, id, call FROM pairs WHERE answer IS NULL",
    "ev_window": f"""WITH {LOG}, p AS (SELECT line, CASE WHEN try_cast(ts AS TIMESTAMP) IS NULL THEN 'unplaced' WHEN try_cast(ts AS TIMESTAMP) BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}' THEN 'in' ELSE 'out' END AS placed FROM log)
SELECT placed, count(*) AS n, min(line) AS first FROM p GROUP BY 1""",
    "dd_normalize": f"SELECT doc_id, md5({NORM}) AS digest FROM documents",
    "dd_exact": f"WITH k AS (SELECT doc_id, {NORM} AS k FROM documents) SELECT min(doc_id) AS doc_id, count(*) AS copies FROM k GROUP BY k",
    "dd_overlap": f"""WITH c AS (SELECT conv_id, turn, {NORM} AS x FROM conversations), p AS (SELECT a.conv_id, a.turn, a.x, b.x AS y FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
g AS (SELECT conv_id, turn, x, y, [list_distinct(list_transform(range(1, greatest(length(t) - 3, 1) + 1), lambda i: substr(t, i, 4))) for t in [x, y]] AS c,
  [CASE WHEN len(w) < 2 THEN [] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END for w in [string_split(x, ' '), string_split(y, ' ')]] AS b FROM p),
j AS (SELECT conv_id, turn, x, y, [CASE WHEN len(s[1]) = 0 AND len(s[2]) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(s[1], s[2])) / len(list_distinct(list_concat(s[1], s[2])))::DOUBLE END for s in [c, b]] AS v FROM g)
SELECT conv_id, turn, round(CASE WHEN x = y THEN 1.0::DOUBLE WHEN x = '' OR y = '' THEN 0.0::DOUBLE ELSE least(v[1], v[2], 0.9995::DOUBLE) END, 6) AS overlap FROM j""",
    "dd_hamming": "SELECT o_orderkey, CAST(bit_count(xor(o_orderkey, o_custkey)) AS BIGINT) AS bits FROM orders",
    "ds_tokens": "SELECT doc_id, CAST(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS tokens FROM documents",
    "ds_headtail": "WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM n WHERE rn <= 4 OR rn > n - 3",
    "cp_drops": """WITH b AS (SELECT p_type AS item FROM part), a AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN lower(p_type) ELSE p_type END AS item FROM part WHERE p_partkey % 4 <> 0),
d AS (SELECT item FROM b EXCEPT ALL SELECT item FROM a), i AS (SELECT item FROM a EXCEPT ALL SELECT item FROM b)
SELECT 'dropped' AS side, count(*) AS n, CAST(coalesce(sum(strlen(item)), 0) AS BIGINT) AS bytes FROM d UNION ALL SELECT 'introduced', count(*), CAST(coalesce(sum(strlen(item)), 0) AS BIGINT) FROM i""",
    "vt_entropy": """WITH c AS (SELECT p_partkey, length(p_name) AS n, unnest(string_split(p_name, '')) AS ch FROM part), k AS (SELECT p_partkey, n, ch, count(*) AS k FROM c GROUP BY ALL)
SELECT p_partkey, round(-sum(k / CAST(n AS DOUBLE) * log2(k / CAST(n AS DOUBLE))) + 0.0, 6) AS bits FROM k GROUP BY 1""",
    "vt_secrets": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}')) AS {n}" for n, p in textual.SECRETS.items()) + " FROM documents",
    "ax_urls": "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '://([^@/?#]*@)?([^/?#]*)', 2)) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS name FROM pages",
}
