"""Ledger queries over the events table: one ledger a user, in order of event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import canon
from plumbline.operators import chain, near, pins, rows
from plumbline.session import settled, table

# ---- fixtures: chained ledgers, a damaged copy, declarations, pins


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    body = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    return events.select(F.col("user_id").cast("string").alias("ledger_id"), line.alias("line"), "event_id", body.alias("body"))


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.build(bodies(spark, sf_dir)).withColumn("raw", F.col("body"))


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows lost, edited, unchained and put in ahead of the chain."""
    rows = chained(spark, sf_dir).where("event_id % 59 <> 0")
    edited = F.when(F.col("event_id") % 53 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    unchained = (F.col("event_id") % 61 == 0) | ((F.col("line") == 1) & (F.col("ledger_id").cast("long") % 3 == 0))
    return rows.withColumn("body", edited).withColumn("raw", edited).withColumn("chain", F.when(~unchained, F.col("chain")))


def declarations(rows: DataFrame) -> DataFrame:
    """Every other unchained or edited row is declared, some of them twice and wrong the first time."""
    hit = rows.where("event_id % 122 = 0 or event_id % 106 = 0")
    right = hit.select("ledger_id", F.col("line").alias("orphan_line"), (F.col("line") + 100000).alias("line"), F.sha2("raw", 256).alias("raw_sha256"), F.lit(None).cast("string").alias("resume_prev"), F.lit("known").alias("why"))
    wrong = right.withColumn("line", F.col("line") - 50000).withColumn("raw_sha256", F.lit("0"))
    return right.unionAll(wrong.where("orphan_line % 2 = 0"))


def pin_rows(rows: DataFrame) -> DataFrame:
    """A pin at every tenth row; some short, rewritten, double, malformed or stamped ahead."""
    place = F.row_number().over(Window.partitionBy("ledger_id").orderBy("line")).cast("long")
    at = rows.withColumn("n", place).where("n % 10 = 0").select(F.col("ledger_id").alias("namespace"), "n", "event_id", "chain")
    kinds = F.col("event_id") % 7
    value = F.when(kinds == 1, F.reverse("chain")).when(kinds == 2, F.lit("xyz")).otherwise(F.upper("chain"))
    count = F.when(kinds == 3, F.col("n") - 10).otherwise(F.col("n"))
    second = F.when(kinds == 4, "2026-01-01 00:10:00").otherwise("2026-01-01 00:00:00")
    first = at.select("namespace", (F.col("n") * 2).alias("line"), count.alias("rows"), value.alias("chain"), second.cast("timestamp").alias("as_of"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("received_at"))
    again = first.where(F.col("line") % 40 == 0).withColumn("line", F.col("line") + 1).withColumn("chain", F.reverse("chain"))
    return first.unionAll(again)


# ---- queries


def led_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chained(spark, sf_dir).select("ledger_id", "line", "chain")


def led_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.verify(damaged(spark, sf_dir))


def led_verify_intact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.verify(chained(spark, sf_dir))


def led_verify_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.verify(damaged(spark, sf_dir), strict=True)


def led_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(damaged(spark, sf_dir))
    return chain.verify(rows, chain.last_declared(declarations(rows)))


def led_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.heads(damaged(spark, sf_dir))


def led_chain_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.chain_at(damaged(spark, sf_dir), 7)


def dg_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", canon.digest_bytes(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


def ex_aat_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold the sha256 of the line before; some lines were lost since."""
    lines = chain.chained_lines(bodies(spark, sf_dir).withColumn("raw", F.col("body")))
    kept = lines.where("event_id % 37 <> 0").withColumnRenamed("prev_hash", "claimed")
    again = chain.chained_lines(kept)
    return again.groupBy("ledger_id").agg(F.count("*").alias("rows"), F.count_if(F.col("claimed") != F.col("prev_hash")).alias("breaks"))


def au_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling hash of each session's turns, all 64 digits, and whether the declared one holds."""
    import hashlib

    from pyspark.sql import types as T

    from plumbline.functions.fold import ordered_fold

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("|", F.col("turn").cast("string"), "role", F.length("text").cast("string")).alias("body"))

    def step(previous: str, row: dict) -> tuple[str, tuple]:
        now = hashlib.sha256((previous + row["body"]).encode()).hexdigest()
        return now, (now,)

    folded = ordered_fold(turns, ["conv_id"], ["turn"], lambda: canon.GENESIS, step, T.StructType([T.StructField("rolling", T.StringType())]))
    last = folded.groupBy("conv_id").agg(F.max_by("rolling", "turn").alias("rolling"), F.count("*").alias("events"))
    declared = F.when(F.col("conv_id") % 5 == 0, F.reverse("rolling")).otherwise(F.col("rolling"))
    return last.select("conv_id", "rolling", "events", (declared == F.col("rolling")).alias("holds"))


def wn_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pins.accepted(pin_rows(chained(spark, sf_dir))).select("namespace", "line", "rows", F.coalesce("reason", F.lit("taken")).alias("reason"))


def wn_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pins.latest(pin_rows(chained(spark, sf_dir)))


def wn_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pins.history(pin_rows(chained(spark, sf_dir)), "7").select("namespace", "line", "rows", "chain")


def wn_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pin_rows(chained(spark, sf_dir))
    return p.groupBy("namespace").agg(F.count_if(pins.strict(F.col("rows"), F.col("chain"), F.col("namespace"))).alias("well_formed"), F.count("*").alias("pins"))


def wn_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pins.equivocal(pin_rows(chained(spark, sf_dir)))


def wn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins of the intact log against a log that lost rows at its end, or was edited. Both chains are built once."""
    rows = settled(chained(spark, sf_dir))
    taken = pins.accepted(pin_rows(rows)).where("reason is null")
    now = rows.where("not (cast(ledger_id as long) % 4 = 0 and line > 30)").withColumn("body", F.when((F.col("ledger_id").cast("long") % 9 == 0) & (F.col("line") == 3), F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    rebuilt = settled(chain.build(now.drop("chain")))
    return pins.compare(taken, rebuilt, chain.verify(rebuilt.where("true")))


def wn_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs, some cut, edited or broken, against witnesses, some of which hold odd pins or fail their own chain."""
    rows = settled(chained(spark, sf_dir))
    checked = pins.accepted(pin_rows(rows))
    held = checked.where("reason is null or cast(namespace as long) % 5 = 0")
    k = F.col("ledger_id").cast("long")
    now = rows.where(~((k % 4 == 0) & (F.col("line") > 30)))
    rebuilt = settled(now.withColumn("body", F.when((k % 11 == 0) & (F.col("line") == 2), F.concat("body", F.lit("!"))).otherwise(F.col("body"))))
    files = rows.select(F.col("ledger_id").alias("namespace")).distinct().where("cast(namespace as long) % 3 <> 2")
    files = files.withColumn("ok", F.when(F.col("namespace").cast("long") % 7 == 0, False).otherwise(True))
    return pins.against_witness(held, files, rebuilt, chain.verify(rebuilt))


def wn_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chained(spark, sf_dir)
    return pins.gaps(pin_rows(rows), rows, limit=5)


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as JSON lines, some torn, blank or with a key twice."""
    body = F.concat(F.lit('{"event": "'), "event_type", F.lit('", "n": '), F.col("event_id").cast("string"), F.lit("}"))
    good = rows.append(bodies(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").withColumn("body", body))
    n = F.get_json_object("body", "$.n").cast("long")
    raw = F.when(n % 67 == 0, "  ").when(n % 59 == 0, F.expr("substring(raw, 1, length(raw) - 7)")).when(n % 61 == 0, F.concat(F.lit('{"n": 0, '), F.expr("substring(raw, 2)"))).otherwise(F.col("raw"))
    return good.select("ledger_id", "line", raw.alias("raw"))


def led_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.verify_lines(json_lines(spark, sf_dir))


def led_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.read_rows(json_lines(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("lines"), F.count("chain").alias("chained"))


def dg_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of canonical JSON; null where the text is none."""
    raw = F.when(F.col("event_id") % 53 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", canon.digest_json(raw).alias("digest"))


def cn_jcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON with numbers in their shortest form and keys in order."""
    raw = F.concat(F.lit('{"p": '), F.format_string("%.3f", "o_totalprice"), F.lit(', "a": [1e2, -0.0, 1E-7], "É": "'), "o_orderstatus", F.lit('"}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", canon.canon_jcs(raw).alias("form"))


def dd_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate turns of conversations, and a copy of every ninth with a word less."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    near_copy = c.where("id % 9 = 0").select((F.col("id") + 10**9).alias("id"), F.regexp_replace("text", r"\s\S+$", "").alias("text"))
    return near.dedupe(c.unionAll(near_copy))


# ---- SQL

BASE = """
WITH RECURSIVE bodies AS (
  SELECT CAST(user_id AS VARCHAR) AS ledger_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, event_id,
         CAST(event_id AS VARCHAR) || '|' || event_type || '|' || props AS body FROM events),
chained AS (
  SELECT ledger_id, line, event_id, body, substr(sha256('genesis' || body), 1, 32) AS chain FROM bodies WHERE line = 1
  UNION ALL
  SELECT b.ledger_id, b.line, b.event_id, b.body, substr(sha256(c.chain || b.body), 1, 32) FROM bodies b JOIN chained c ON b.ledger_id = c.ledger_id AND b.line = c.line + 1)
"""
DAMAGED = """,
damaged AS (
  SELECT ledger_id, line, event_id, CASE WHEN event_id % 53 = 0 THEN body || '!' ELSE body END AS body,
         CASE WHEN NOT (event_id % 61 = 0 OR (line = 1 AND CAST(ledger_id AS BIGINT) % 3 = 0)) THEN chain END AS chain
  FROM chained WHERE event_id % 59 <> 0),
said AS (
  SELECT ledger_id, line, sha256(body) AS sha FROM damaged WHERE event_id % 122 = 0 OR event_id % 106 = 0)
"""
PINS = """,
at10 AS (SELECT ledger_id AS namespace, line AS n, event_id, chain FROM chained WHERE line % 10 = 0),
pins1 AS (
  SELECT namespace, n * 2 AS line, CASE WHEN event_id % 7 = 3 THEN n - 10 ELSE n END AS rows,
         CASE event_id % 7 WHEN 1 THEN reverse(chain) WHEN 2 THEN 'xyz' ELSE upper(chain) END AS chain, event_id % 7 = 4 AS ahead FROM at10),
pins AS (SELECT * FROM pins1 UNION ALL SELECT namespace, line + 1, rows, reverse(chain), ahead FROM pins1 WHERE line % 40 = 0),
shaped AS (SELECT *, regexp_full_match(lower(chain), 'genesis|[0-9a-f]{32}') AS shape FROM pins),
rising AS (SELECT *, coalesce(max(CASE WHEN shape AND NOT ahead THEN rows END) OVER (PARTITION BY namespace ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) <= rows AS up FROM shaped),
firsts AS (SELECT *, first_value(CASE WHEN shape AND NOT ahead AND up THEN lower(chain) END IGNORE NULLS) OVER (PARTITION BY namespace, rows ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM rising),
guarded AS (SELECT namespace, line, rows, chain, CASE WHEN NOT shape THEN 'malformed' WHEN NOT up THEN 'behind' WHEN held <> lower(chain) THEN 'equivocation' WHEN ahead THEN 'ahead' ELSE 'taken' END AS reason FROM firsts)
"""


def _verify_sql(source: str, excused: str, strict: bool = False) -> str:
    return f""",
marked AS (SELECT d.*, {excused} AS excused, coalesce(min(CASE WHEN chain IS NOT NULL THEN line END) OVER (PARTITION BY ledger_id) < line, false) AS started FROM {source} d),
outs AS (SELECT *, CASE WHEN chain IS NOT NULL THEN chain WHEN started AND excused THEN 'genesis' END AS o FROM marked),
prevs AS (SELECT *, coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY ledger_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'genesis') AS p FROM outs),
kinds AS (SELECT *, CASE WHEN chain IS NULL AND NOT started THEN '{"break" if strict else "prechain"}' WHEN chain = substr(sha256(p || body), 1, 32) THEN 'ok' WHEN excused THEN 'declared' ELSE 'break' END AS kind FROM prevs),
sums AS (SELECT ledger_id, count(*) AS rows, count(chain) AS chained, count(*) FILTER (kind = 'prechain') AS prechain, count(*) FILTER (kind = 'break') AS breaks,
  count(*) FILTER (kind = 'declared') AS declared_breaks, min(line) FILTER (kind = 'break') AS first_break FROM kinds GROUP BY 1)
SELECT *, CASE WHEN prechain > 0 AND declared_breaks > 0 THEN 'bounded_prechain_skipped+declared_break' WHEN prechain > 0 THEN 'bounded_prechain_skipped' WHEN declared_breaks > 0 THEN 'bounded_declared_break' ELSE 'full' END AS scope,
  CASE WHEN breaks > 0 THEN false WHEN prechain > 0 OR declared_breaks > 0 THEN NULL ELSE true END AS ok FROM sums"""


JSON_BASE = """
WITH RECURSIVE bodies AS (
  SELECT CAST(user_id AS VARCHAR) AS ledger_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, event_id, '{"event": "' || event_type || '", "n": ' || event_id || '}' AS body FROM events),
chained AS (
  SELECT ledger_id, line, event_id, body, substr(sha256('genesis' || body), 1, 32) AS chain FROM bodies WHERE line = 1
  UNION ALL
  SELECT b.ledger_id, b.line, b.event_id, b.body, substr(sha256(c.chain || b.body), 1, 32) FROM bodies b JOIN chained c ON b.ledger_id = c.ledger_id AND b.line = c.line + 1),
damaged AS (SELECT * FROM chained WHERE event_id % 67 <> 0 AND event_id % 59 <> 0 AND event_id % 61 <> 0),
unread AS (SELECT ledger_id, count(*) FILTER (event_id % 67 <> 0 AND (event_id % 59 = 0 OR event_id % 61 = 0)) AS unreadable FROM bodies GROUP BY 1)
"""

QUERIES = {f.__name__: f for f in (led_build, led_verify, led_verify_intact, led_verify_strict, led_declared, led_head, led_chain_at, dg_bytes, ex_aat_verify, au_replay, wn_guard, wn_latest, wn_history, wn_strict, wn_equiv, wn_check, wn_verdict, wn_gap, led_lines, led_states, dg_json, cn_jcs, dd_near)}

ORACLE = {
    "led_build": BASE + "SELECT ledger_id, line, chain FROM chained",
    "led_verify": BASE + DAMAGED + _verify_sql("damaged", "false"),
    "led_verify_intact": BASE + _verify_sql("chained", "false"),
    "led_verify_strict": BASE + DAMAGED + _verify_sql("damaged", "false", strict=True),
    "led_declared": BASE + DAMAGED + _verify_sql("damaged", "exists(SELECT 1 FROM said s WHERE s.ledger_id = d.ledger_id AND s.line = d.line AND s.sha = sha256(d.body))"),
    "led_head": BASE + DAMAGED + "SELECT ledger_id, count(*) AS rows, coalesce(last(chain ORDER BY line), 'genesis') AS head FROM damaged GROUP BY 1",
    "led_chain_at": BASE + DAMAGED + ", n AS (SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY line) AS k FROM damaged) SELECT ledger_id, coalesce(chain, 'genesis') AS chain FROM n WHERE k = 7",
    "dg_bytes": "SELECT doc_id, 'sha256:raw-bytes:v1:' || sha256(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents",
    "ex_aat_verify": """WITH b AS (SELECT CAST(user_id AS VARCHAR) AS ledger_id, event_id, CAST(event_id AS VARCHAR) || '|' || event_type || '|' || props AS raw FROM events),
c AS (SELECT *, coalesce(sha256(lag(raw) OVER (PARTITION BY ledger_id ORDER BY event_id)), 'genesis') AS claimed FROM b),
k AS (SELECT *, coalesce(sha256(lag(raw) OVER (PARTITION BY ledger_id ORDER BY event_id)), 'genesis') AS now FROM c WHERE event_id % 37 <> 0)
SELECT ledger_id, count(*) AS rows, count(*) FILTER (claimed <> now) AS breaks FROM k GROUP BY 1""",
    "au_replay": """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CAST(turn AS VARCHAR) || '|' || role || '|' || CAST(length(text) AS VARCHAR) AS body FROM conversations),
f AS (SELECT conv_id, k, sha256('genesis' || body) AS h FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.k, sha256(f.h || t.body) FROM t JOIN f ON t.conv_id = f.conv_id AND t.k = f.k + 1)
SELECT conv_id, last(h ORDER BY k) AS rolling, count(*) AS events, CASE WHEN conv_id % 5 = 0 THEN reverse(last(h ORDER BY k)) = last(h ORDER BY k) ELSE true END AS holds FROM f GROUP BY 1""",
    "wn_guard": BASE + PINS + "SELECT namespace, line, rows, reason FROM guarded",
    "wn_latest": BASE + PINS + "SELECT namespace, last(rows ORDER BY line) AS rows, last(chain ORDER BY line) AS chain, max(line) AS line FROM pins GROUP BY 1",
    "wn_history": BASE + PINS + "SELECT namespace, line, rows, chain FROM pins WHERE namespace = '7' ORDER BY line",
    "wn_strict": BASE + PINS + "SELECT namespace, count(*) FILTER (shape) AS well_formed, count(*) AS pins FROM shaped GROUP BY 1",
    "wn_equiv": BASE + PINS + ", e AS (SELECT namespace, rows FROM pins GROUP BY 1, 2 HAVING count(DISTINCT lower(chain)) > 1) SELECT namespace, min(rows) AS rows FROM e GROUP BY 1",
    "wn_check": BASE + PINS + """, nb AS (SELECT ledger_id, line, CASE WHEN CAST(ledger_id AS BIGINT) % 9 = 0 AND line = 3 THEN body || '!' ELSE body END AS body FROM bodies WHERE NOT (CAST(ledger_id AS BIGINT) % 4 = 0 AND line > 30)),
nc AS (SELECT ledger_id, line, substr(sha256('genesis' || body), 1, 32) AS chain FROM nb WHERE line = 1 UNION ALL SELECT b.ledger_id, b.line, substr(sha256(c.chain || b.body), 1, 32) FROM nb b JOIN nc c ON b.ledger_id = c.ledger_id AND b.line = c.line + 1),
sz AS (SELECT ledger_id AS namespace, count(*) AS n FROM nc GROUP BY 1),
f AS (SELECT g.namespace, CASE WHEN g.rows = 0 THEN 'no_record' WHEN coalesce(sz.n, 0) < g.rows THEN 'truncated' WHEN nc.chain <> lower(g.chain) THEN 'rewritten' ELSE 'consistent' END AS w
  FROM guarded g LEFT JOIN sz USING (namespace) LEFT JOIN nc ON nc.ledger_id = g.namespace AND nc.line = g.rows WHERE reason = 'taken')
SELECT sz.namespace, count(w) AS pins, CASE WHEN count(w) = 0 THEN 'no_record' WHEN bool_or(w = 'truncated') THEN 'truncated' WHEN bool_or(w = 'rewritten') THEN 'rewritten' WHEN bool_or(w = 'consistent') THEN 'consistent' ELSE 'no_record' END AS verdict
FROM sz LEFT JOIN f USING (namespace) GROUP BY 1""",
    "wn_verdict": BASE + PINS + """, h AS (SELECT *, lower(chain) AS c FROM guarded WHERE reason = 'taken' OR CAST(namespace AS BIGINT) % 5 = 0),
n AS (SELECT ledger_id AS namespace, CAST(ledger_id AS BIGINT) AS k, line, chain FROM chained WHERE NOT (CAST(ledger_id AS BIGINT) % 4 = 0 AND line > 30)),
sz AS (SELECT namespace, any_value(k) AS k, count(*) AS n FROM n GROUP BY 1),
f AS (SELECT h.namespace, h.reason = 'malformed' AS odd, h.rows, h.c, CASE WHEN h.reason = 'malformed' THEN NULL WHEN h.rows = 0 THEN 'no_record' WHEN coalesce(sz.n, 0) < h.rows THEN 'truncated' WHEN n.chain <> h.c THEN 'rewritten' ELSE 'consistent' END AS w FROM h LEFT JOIN sz USING (namespace) LEFT JOIN n ON n.namespace = h.namespace AND n.line = h.rows),
tw AS (SELECT DISTINCT namespace FROM (SELECT namespace, rows FROM f WHERE NOT odd AND rows > 0 GROUP BY 1, 2 HAVING count(DISTINCT c) > 1)),
g AS (SELECT sz.namespace, any_value(k) AS k, any_value(n) AS n, count(f.rows) AS pins, coalesce(bool_or(odd), false) AS odd, coalesce(bool_or(w = 'truncated'), false) AS truncated, coalesce(bool_or(w = 'rewritten'), false) AS rewritten, coalesce(bool_or(w = 'consistent'), false) AS fine FROM sz LEFT JOIN f ON f.namespace = sz.namespace GROUP BY 1)
SELECT namespace, pins, CASE WHEN k % 3 <> 2 AND k % 7 = 0 AND pins > 0 THEN 'witness_broken' WHEN odd THEN 'witness_unreadable' WHEN k % 11 = 0 AND n >= 2 THEN 'local_broken' WHEN namespace IN (SELECT namespace FROM tw) THEN 'witness_broken' WHEN truncated THEN 'truncated' WHEN rewritten THEN 'rewritten' WHEN fine THEN 'consistent' ELSE 'no_record' END AS verdict,
  CASE WHEN k % 3 = 2 THEN 'unestablished' WHEN k % 7 = 0 THEN 'broken' ELSE 'verified' END AS witness FROM g""",
    "led_lines": JSON_BASE + _verify_sql("damaged", "false").replace("FROM sums", "FROM sums JOIN unread USING (ledger_id)"),
    "led_states": """SELECT CASE WHEN event_id % 67 = 0 THEN 'blank' WHEN event_id % 59 = 0 OR event_id % 61 = 0 THEN 'unreadable' ELSE 'row' END AS state, count(*) AS lines, count(*) FILTER (event_id % 67 <> 0 AND event_id % 59 <> 0 AND event_id % 61 <> 0) AS chained FROM events GROUP BY 1""",
    "dg_json": "SELECT event_id, CASE WHEN event_id % 53 <> 0 THEN 'sha256:json-c14n:v1:' || sha256(replace(props, ' ', '')) END AS digest FROM events",
    "cn_jcs": """SELECT o_orderkey, '{"a":[100,0,1e-7],"p":' || regexp_replace(CAST(CAST(printf('%.3f', o_totalprice) AS DOUBLE) AS VARCHAR), '[.]0$', '') || ',"É":"' || o_orderstatus || '"}' AS form FROM orders""",
    "wn_gap": BASE + PINS + ", l AS (SELECT namespace, last(rows ORDER BY line) AS r FROM pins GROUP BY 1), s AS (SELECT ledger_id, count(*) AS n FROM bodies GROUP BY 1) SELECT namespace, n - r AS gap, n - r > 5 AS stale FROM l JOIN s ON s.ledger_id = l.namespace",
}
