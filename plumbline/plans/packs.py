"""Queries on evidence packs: built from ledgers of events, damaged in one way or another, and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import packs, rows
from plumbline.session import settled, table

SINCE, UNTIL = "2024-01-08 00:00:00", "2024-01-22 00:00:00"
ALLOWED = ["click", "view", "purchase"]


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger a user: chained lines of events; some have no event, and some can't be read any more."""
    e = table(spark, sf_dir, "events")
    event = F.when(F.col("event_id") % 31 == 0, "").otherwise(F.concat(F.lit('"event": "'), "event_type", F.lit('", ')))
    body = F.concat(F.lit("{"), event, F.lit('"id": '), F.col("event_id").cast("string"), F.lit(', "ts": "'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('"}'))
    made = e.select(F.col("user_id").cast("string").alias("ledger_id"), F.col("event_id").alias("line"), body.alias("body"))
    numbered = made.withColumn("line", F.row_number().over(Window.partitionBy("ledger_id").orderBy("line")).cast("long"))
    torn = (F.col("ledger_id").cast("long") % 5 == 4) & (F.col("line") % 9 == 3)
    return rows.append(numbered).select("ledger_id", "line", F.when(torn, F.expr("substring(raw, 1, 20)")).otherwise(F.col("raw")).alias("raw"))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of all ledgers, of which each but every seventh has been damaged in a way that its number tells."""
    source = settled(ledgers(spark, sf_dir))
    pins = source.where("line % 10 = 0 and cast(ledger_id as long) % 3 <> 0").select("ledger_id", F.col("line").alias("rows"), F.get_json_object("raw", "$.chain").alias("chain")).where("chain is not null")
    made = packs.build(source, pins, SINCE, UNTIL, ALLOWED)
    one = lambda n: F.col("pack").cast("long") % 7 == n
    hurt = dict(made)
    window = made["window"].withColumn("raw", F.when(one(1) & (F.col("line") % 4 == 0), F.replace("raw", F.lit('"id"'), F.lit('"ib"'))).otherwise(F.col("raw")))
    hurt["window"] = settled(window.where(~(one(2) & (F.col("line") % 6 == 0))))
    value = F.when(one(3) & (F.col("field") == "denied"), F.lit("-1")).otherwise(F.col("value"))
    hurt["fields"] = settled(made["fields"].where(~(one(4) & (F.col("section") == "statements"))).withColumn("value", value))
    ids = source.select(F.col("ledger_id").alias("pack")).distinct()
    fresh = packs.sealed(ids, hurt["window"], hurt["fields"], made["pins"])
    # a forger seals again what was changed, but for packs 1 of 7
    hurt["manifest"] = made["manifest"].where(one(1)).unionAll(fresh.where(~one(1)))
    store = pins.where("cast(ledger_id as long) % 7 <> 5")
    return packs.check(ids, hurt, source.where("cast(ledger_id as long) % 7 <> 6"), store, SINCE, UNTIL, ALLOWED)


def ev_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir)


def ev_pack_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.verdicts(checked(spark, sf_dir))


def ev_pack_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is derived from each ledger's window."""
    source = ledgers(spark, sf_dir)
    ids = source.select(F.col("ledger_id").alias("pack")).distinct()
    return packs.derived(ids, packs.in_window(source, SINCE, UNTIL), ALLOWED).where("field <> 'head'")


QUERIES = {f.__name__: f for f in (ev_pack, ev_pack_verdicts, ev_pack_fields)}

# ---- SQL

LINES = f"""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS pack, user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, CASE WHEN event_id % 31 <> 0 THEN event_type END AS event FROM events),
s AS (SELECT *, u % 5 = 4 AND line % 9 = 3 AS torn FROM l),
w AS (SELECT * FROM s WHERE torn OR stamp BETWEEN '{SINCE}' AND '{UNTIL}'),
ids AS (SELECT DISTINCT pack, u FROM s),
g AS (SELECT ids.pack, any_value(ids.u) AS u, count(w.line) AS rows, min(line) AS first_line, max(line) AS last_line, max(CASE WHEN NOT torn THEN stamp END) AS newest, count(*) FILTER (NOT torn AND event IN ('{"', '".join(ALLOWED)}')) AS allowed,
  count(*) FILTER (NOT torn AND event NOT IN ('{"', '".join(ALLOWED)}')) AS denied, count(*) FILTER (w.line IS NOT NULL AND (torn OR event IS NULL)) AS undecided, count(*) FILTER (torn) AS unreadable FROM ids LEFT JOIN w ON w.pack = ids.pack GROUP BY ids.pack)"""
CHECKED = LINES + """,
p AS (SELECT pack, count(*) AS pins FROM s WHERE line % 10 = 0 AND u % 3 <> 0 AND NOT torn GROUP BY 1),
r AS (SELECT pack, bool_or(line % 4 = 0 AND (NOT torn OR event IS NULL)) AS changed, bool_or(line % 6 = 0) AS dropped, bool_or(torn AND line % 6 = 0) AS dropped_torn, coalesce(max(CASE WHEN NOT torn THEN line END) % 6 = 0, false) AS dropped_last FROM w GROUP BY 1),
d AS (SELECT g.pack, g.u % 7 AS k, coalesce(pins, 0) AS pins, unreadable > 0 OR rows = 0 AS said, coalesce(changed, false) AS changed, coalesce(dropped, false) AS dropped, coalesce(dropped_torn, false) AS dropped_torn, coalesce(dropped_last, false) AS dropped_last
  FROM g LEFT JOIN p ON p.pack = g.pack LEFT JOIN r ON r.pack = g.pack),
b AS (SELECT *, CASE WHEN k = 6 THEN 'could_not_look' WHEN k = 1 AND changed THEN 'bad' ELSE 'good' END AS base FROM d),
c AS (SELECT pack, k, base, 'manifest' AS "check", k = 1 AND changed AS bad, false AS unknown, false AS rests FROM b UNION ALL SELECT pack, k, base, 'window', base = 'bad', k = 6, false FROM b UNION ALL
  SELECT pack, k, base, 'complete', k = 2 AND dropped, false, true FROM b UNION ALL SELECT pack, k, base, 'chain', k = 2 AND dropped_last, false, true FROM b UNION ALL
  SELECT pack, k, base, 'export', k = 2 AND dropped, false, true FROM b UNION ALL SELECT pack, k, base, 'mandate', k = 3 OR (k = 2 AND dropped), false, true FROM b UNION ALL
  SELECT pack, k, base, 'statements', (k = 4 AND said) OR (k = 2 AND dropped_torn), said, true FROM b UNION ALL SELECT pack, k, base, 'pins', k = 5 AND pins > 0, pins = 0, false FROM b),
checks AS (SELECT pack, "check", CASE WHEN rests AND base <> 'good' THEN 'could_not_look' WHEN bad THEN 'bad' WHEN unknown THEN 'could_not_look' ELSE 'good' END AS outcome FROM c)"""

ORACLE = {
    "ev_pack": CHECKED + " SELECT * FROM checks",
    "ev_pack_verdicts": CHECKED + " SELECT pack, CASE min(CASE outcome WHEN 'bad' THEN 0 WHEN 'could_not_look' THEN 1 ELSE 2 END) WHEN 0 THEN 'bad' WHEN 1 THEN 'could_not_look' ELSE 'good' END AS verdict, count(*) FILTER (outcome = 'bad') AS bad, count(*) FILTER (outcome = 'could_not_look') AS could_not_look FROM checks GROUP BY 1",
    "ev_pack_fields": LINES + """,
n AS (SELECT pack, event, count(*) AS n FROM w WHERE NOT torn AND event IS NOT NULL GROUP BY 1, 2)
SELECT pack, 'export' AS section, unnest(['rows', 'first_line', 'last_line', 'newest']) AS field, unnest([CAST(rows AS VARCHAR), coalesce(CAST(first_line AS VARCHAR), ''), coalesce(CAST(last_line AS VARCHAR), ''), coalesce(newest, '')]) AS value FROM g UNION ALL
SELECT pack, 'export', 'event:' || event, CAST(n AS VARCHAR) FROM n UNION ALL
SELECT pack, 'mandate', unnest(['allowed', 'denied', 'undecided']), unnest([CAST(allowed AS VARCHAR), CAST(denied AS VARCHAR), CAST(undecided AS VARCHAR)]) FROM g UNION ALL
SELECT pack, 'statements', 'unreadable', CAST(unreadable AS VARCHAR) FROM g WHERE unreadable > 0 UNION ALL SELECT pack, 'statements', 'empty', '1' FROM g WHERE rows = 0""",
}
