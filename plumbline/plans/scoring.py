"""Queries on scored answers, baselines, tables, chunks and findings on lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.textual import SECRETS
from plumbline.operators import scoring
from plumbline.session import table

# ---- fixtures


#: What is said of a part's size, by key modulo 16; {} is the size.
SAID = [None, "I don't know.  Perhaps {}!", "No idea", "It is {}.5 or so", "It  is {}.", "1{} at most", "roughly {},000 units", "about {}e2 then", "v{}.{}.{}", "It could be {} or 99", "Answer: +{}", "not sufficient information", "N/A", "it is -{}.0", "impossible to know", "X{}X"]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to items on parts: right, close, in thousands or with an exponent, part of something else, listed, hedged or missing."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    said = F.get(F.array(*[F.lit(t) for t in SAID]), (k % 16).cast("int"))
    kind = F.when(k % 3 == 0, "exact_match").when(k % 3 == 1, "numeric_tolerance").otherwise("calibration")
    number = F.col("p_size").cast("double") * F.when(k % 16 == 6, 1000).when(k % 16 == 7, 100).otherwise(1)
    return table(spark, sf_dir, "part").select(k.alias("id"), F.replace(said, F.lit("{}"), size).alias("said"), kind.alias("kind"), size.alias("answer"), number.alias("number"), (k % 5 != 2).alias("answerable"), F.when(k % 4 < 2, F.array(F.lit("99"), F.lit("Many."))).alias("distractors"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return answers(spark, sf_dir).select("id", "kind", scoring.score_item(c("kind"), c("said"), c("answer"), c("number"), c("answerable"), 0.5, c("distractors")).alias("score"))


#: A second line of settings, by key modulo 12; {n} is the first n digits of a digest, {U16} the first 16 in capitals.
ENV = ["AWS=AKIA{U16}", "API_KEY='{24}'", "PASSWORD=your-password-1234567", "NAME={64}", "S=sk_live_{30}", "T_TOKEN=ghp_{36}", "X = github_pat_{30}", "MY_SECRET=aaaa1111aaaa1111", "token={64}", "STRIPE_KEY=sk_test_{64}", "OPENAI=sk-{24}", "DB_PASSWORD={12}"]


def env_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest, k = F.sha2(F.col("c_custkey").cast("string"), 256), F.col("c_custkey")
    line = F.get(F.array(*[F.lit(t) for t in ENV]), (k % 12).cast("int"))
    line = F.replace(line, F.lit("{U16}"), F.upper(F.substring(digest, 1, 16)))
    for n in (12, 24, 30, 36, 64):
        line = F.replace(line, F.lit(f"{{{n}}}"), F.substring(digest, 1, n))
    return table(spark, sf_dir, "customer").select(k.alias("key"), F.concat(F.lit("# settings\n"), line, F.lit("\n\nMODE = x\nTOKEN=short1\n")).alias("text"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of three kinds: JSON, lines with delimiters, prose."""
    k = F.col("o_orderkey")
    rows = F.transform(F.sequence(F.lit(1), 1 + (k % 5).cast("int")), lambda i: F.concat_ws(",", i.cast("string"), "o_orderstatus", F.when((k % 3 == 0) & (i == 2), "a,b,c").otherwise("a")))
    text = F.when(k % 4 == 0, F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}"))).when(k % 4 == 1, F.lit("[1, 2")).otherwise(F.array_join(rows, "\n"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text"))


# ---- queries


def bl_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)


def bl_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    return a.where(scoring.holds_number(F.col("said"), F.col("number"), 1.0)).select("id")


def bl_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration items by points."""
    return scored(spark, sf_dir).where("kind = 'calibration'").groupBy("score").agg(F.count("*").alias("n"))


def bl_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = scored(spark, sf_dir)
    after = before.withColumn("score", F.when(F.col("id") % 13 == 0, F.lit(None)).when(F.col("id") % 17 == 0, 1.0).otherwise(F.col("score")))
    small = lambda x: x.where("id <= 24 and id % 11 <> 0 and id % 13 <> 0")
    return scoring.compare_runs(before, after).unionAll(scoring.compare_runs(small(before), small(after)))


def bl_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.set_digest(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v")), "k", "v")


def ds_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).select("id", scoring.kind_of(F.col("text")).alias("kind"))


def ds_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", F.concat_ws(",", F.col("event_id").cast("string"), "event_type", "props").alias("text"))
    return scoring.fit_rows(rows, "key", "event_id", "text", 600)


def ds_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", scoring.sentences(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0), lambda m, x: F.greatest(m, F.length(x))).cast("long").alias("longest"))


def ci_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.chunks(paragraphs(spark, sf_dir), 1000)


def vt_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.env_findings(env_texts(spark, sf_dir), SECRETS)


def cp_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    q, d = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    li = table(spark, sf_dir, "lineitem").select(
        k.alias("id"), d.alias("n"), (1 + k % 2).alias("version"), (q + d + F.when(k % 10 == 3, 1).otherwise(0)).alias("pre"), q.alias("kept"), d.alias("dropped"), (k % 4).alias("introduced"), (q + k % 4 - F.when(k % 9 == 4, 1).otherwise(0)).alias("post")
    )
    c = F.col
    return li.select("id", "n", scoring.reconciles(c("version"), c("pre"), c("kept"), c("dropped"), c("introduced"), c("post")).alias("ok"))


def cp_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's items: a digest of their digests in order, and their bytes."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("d"), F.octet_length("text").alias("size"))
    listed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "d"))).alias("items"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return listed.select("conv_id", F.sha2(F.array_join("items.d", "\n"), 256).alias("digest"), "bytes", "n")


def sc_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences by severity, the first of each named."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 7 == 0).alias("divergent"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("notable").alias("severity"))
    return c.where("divergent").groupBy("severity").agg(F.count("*").alias("n"), F.min("id").alias("first"))


QUERIES = {f.__name__: f for f in (bl_score, bl_numeric, bl_calibration, bl_compare, bl_set_digest, ds_tabular, ds_fit, ds_sentences, ci_chunks, vt_env, cp_reconcile, cp_manifest, sc_severity)}

# ---- SQL

Q = lambda text: "'" + text.replace("'", "''") + "'"
SCORED = rf"""WITH p AS (SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS answer, p_size * CASE p_partkey % 16 WHEN 6 THEN 1000 WHEN 7 THEN 100 ELSE 1 END AS number, p_partkey % 5 <> 2 AS answerable, CASE WHEN p_partkey % 4 < 2 THEN ['99', 'many'] ELSE [] END AS wrong,
  ['exact_match', 'numeric_tolerance', 'calibration'][p_partkey % 3 + 1] AS kind, replace([{", ".join("NULL" if t is None else Q(t) for t in SAID)}][p_partkey % 16 + 1], '{{}}', CAST(p_size AS VARCHAR)) AS text FROM part),
t AS (SELECT *, regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[.!?]+$', '') AS said,
  list_transform(list_filter(list_transform(string_split_regex(text, '\s+'), lambda w: rtrim(w, '.!?,')), lambda w: regexp_full_match(w, '[-+]?(\d{{1,3}}(,\d{{3}})+|\d+)(\.\d+)?([eE][-+]?\d+)?')), lambda w: CAST(replace(w, ',', '') AS DOUBLE)) AS numbers FROM p),
h AS (SELECT *, regexp_matches(said, '(^|[^\w.])' || answer || '($|[^\w.,]|[.,]($|[^0-9]))') AS hit, len(list_filter(wrong, lambda d: regexp_matches(said, '(^|[^\w.])' || d || '($|[^\w.,]|[.,]($|[^0-9]))'))) > 0 AS named,
  regexp_matches(said, {Q("|".join(scoring.ABSTAINS))}) AS idk FROM t),
s AS (SELECT id, kind, CASE WHEN text IS NULL THEN NULL WHEN kind = 'exact_match' THEN CAST(hit AND NOT named AS DOUBLE) WHEN kind = 'numeric_tolerance' THEN CAST(len(list_filter(numbers, lambda x: abs(x - number) <= 0.5)) > 0 AS DOUBLE)
  WHEN answerable AND hit AND NOT named THEN 1.0 WHEN (answerable AND hit) OR idk THEN CASE WHEN answerable THEN 0.2 ELSE 1.0 END ELSE -1.0 END AS score FROM h)"""
COMPARED = """, r AS (SELECT 0 AS part, id, score AS x, CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN 1.0 ELSE score END AS y FROM s),
b AS (SELECT * FROM r UNION ALL SELECT 1, id, x, y FROM r WHERE id <= 24 AND id % 11 <> 0 AND id % 13 <> 0),
g AS (SELECT part, count(*) AS n, count(*) FILTER (x IS DISTINCT FROM y) AS flips, round(avg(x), 6) AS mean_before, round(avg(y), 6) AS mean_after, count(*) FILTER (x IS NULL) AS ub, count(y) AS scored FROM b GROUP BY 1)
SELECT n, flips, mean_before, mean_after, round(mean_after - mean_before, 6) AS delta, CASE WHEN ub > 0 AND n > scored THEN 'bounded_both_unscored' WHEN ub > 0 THEN 'bounded_before_unscored' WHEN n > scored THEN 'bounded_after_unscored' ELSE 'full' END AS scope,
  CASE WHEN scored >= 30 THEN NULL WHEN abs(round(mean_after - mean_before, 6)) < 2.0 / scored THEN 'within_noise' ELSE 'small_sample' END AS note FROM g"""

ORACLE = {
    "bl_score": SCORED + " SELECT id, kind, score FROM s",
    "bl_numeric": SCORED + " SELECT id FROM t WHERE text IS NOT NULL AND len(list_filter(numbers, lambda x: abs(x - number) <= 1)) > 0",
    "bl_calibration": SCORED + " SELECT score, count(*) AS n FROM s WHERE kind = 'calibration' GROUP BY 1",
    "bl_compare": SCORED + COMPARED,
    "bl_set_digest": """WITH h AS (SELECT CAST('0x' || substr(sha256('{"k":' || p_partkey || ',"v":"' || p_brand || '"}'), 1, 15) AS BIGINT) AS one FROM part) SELECT count(*) AS n, CAST(sum(one) AS VARCHAR) AS total, bit_xor(one) AS mix FROM h""",
    "ds_tabular": r"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 + 1 AS n, o_orderkey % 3 = 0 AS odd FROM orders)
SELECT k AS id, CASE WHEN k % 4 = 0 THEN 'json' WHEN k % 4 = 1 THEN 'text' WHEN n >= 3 THEN 'table' ELSE 'text' END AS kind FROM o""",
    "ds_fit": """WITH e AS (SELECT user_id AS key, CAST(event_id AS VARCHAR) || ',' || event_type || ',' || props AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT unnest([40, 20, 10, 5, 4]) AS cap), s AS (SELECT key, cap, max(n) AS n, coalesce(sum(length(t)) FILTER (n <= cap OR k <= (cap + 1) // 2 OR k > n - cap // 2), 0) AS size FROM e, c GROUP BY 1, 2),
b AS (SELECT key, max(n) AS n, coalesce(max(cap) FILTER (size <= 600), 4) AS cap FROM s GROUP BY 1),
d AS (SELECT e.key, count(*) AS dropped, bit_xor(CAST('0x' || substr(md5(t), 1, 15) AS BIGINT)) AS digest FROM e JOIN b ON b.key = e.key WHERE e.n > b.cap AND e.k > (b.cap + 1) // 2 AND e.k <= e.n - b.cap // 2 GROUP BY 1)
SELECT b.key, CAST(b.cap AS INTEGER) AS cap, b.n - coalesce(dropped, 0) AS kept, coalesce(dropped, 0) AS dropped, digest FROM b LEFT JOIN d ON d.key = b.key""",
    "ds_sentences": r"""WITH d AS (SELECT doc_id, regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(1), 'g') AS t FROM documents),
s AS (SELECT doc_id, list_filter(string_split(t, chr(1)), lambda x: x <> '') AS s FROM d) SELECT doc_id, len(s) AS n, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM s""",
    "vt_env": rf"""WITH c AS (SELECT c_custkey AS key, sha256(CAST(c_custkey AS VARCHAR)) AS d, [{", ".join(map(Q, ENV))}][c_custkey % 12 + 1] AS line FROM customer),
t AS (SELECT key, unnest(['# settings', replace(replace(replace(replace(replace(replace(line, '{{U16}}', upper(substr(d, 1, 16))), '{{12}}', substr(d, 1, 12)), '{{24}}', substr(d, 1, 24)), '{{30}}', substr(d, 1, 30)), '{{36}}', substr(d, 1, 36)), '{{64}}', d), '', 'MODE = x', 'TOKEN=short1', '']) AS raw, unnest(range(1, 7)) AS line FROM c),
v AS (SELECT key, line, regexp_extract(trim(raw), '{scoring.ENV_LINE}', 1) AS name, trim(regexp_extract(trim(raw), '{scoring.ENV_LINE}', 2), chr(39) || chr(34)) AS value FROM t),
w AS (SELECT *, list_filter([{", ".join(f"{{'what': '{n}', 'match': regexp_extract(value, '{p}')}}" for n, p in SECRETS.items())}], lambda x: x.match <> '') AS hits, len(list_filter([{", ".join(map(Q, scoring.PUBLIC))}], lambda p: starts_with(value, p))) > 0 AS public FROM v WHERE name <> ''),
ch AS (SELECT key, line, unnest(string_split(value, '')) AS x, length(value) AS n FROM w), m AS (SELECT key, line, n, x, count(*) AS m FROM ch GROUP BY ALL), e AS (SELECT key, line, -sum(m / n * log2(m / n)) AS bits FROM m GROUP BY ALL),
f AS (SELECT w.*, CASE WHEN len(hits) > 0 AND NOT public THEN 'high' WHEN (regexp_matches(name, '{scoring.SECRET_NAME}') OR lower(name) IN ({", ".join(map(Q, scoring.SECRET_NAMES))})) AND NOT public AND length(value) >= 16 AND bits >= 3.5 AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')
  AND len(list_filter([{", ".join(map(Q, scoring.PLACEHOLDERS))}], lambda p: contains(lower(value), p))) = 0 THEN 'medium' END AS level FROM w LEFT JOIN e ON e.key = w.key AND e.line = w.line),
o AS (SELECT *, CASE WHEN level = 'high' THEN hits[1].match ELSE value END AS secret FROM f WHERE level IS NOT NULL)
SELECT key, line, name, level, CASE WHEN level = 'high' THEN hits[1].what ELSE 'live_value' END AS what, substr(secret, 1, 6) || '... (' || length(secret) || ' chars)' AS shown FROM o""",
    "cp_reconcile": "SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS n, l_orderkey % 10 <> 3 AND (CASE WHEN l_orderkey % 2 = 1 THEN l_orderkey % 9 <> 4 ELSE l_orderkey % 4 - CASE WHEN l_orderkey % 9 = 4 THEN 1 ELSE 0 END >= 0 END) AS ok FROM lineitem",
    "cp_manifest": "SELECT conv_id, sha256(string_agg(sha256(text), chr(10) ORDER BY turn)) AS digest, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS n FROM conversations GROUP BY 1",
    "sc_severity": "SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'notable' END AS severity, count(*) AS n, min(c_custkey) AS first FROM customer WHERE c_custkey % 7 = 0 GROUP BY 1",
}
