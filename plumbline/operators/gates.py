"""Mandate gates, session spend, status roll-ups and small predicates over logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.fold import ordered_fold

#: Pages hold this many receipts; a running hash is noted at every so many events.
PAGE, CHECKPOINT = 20, 500
PHONE = r"^\+?[\d\-.\s()]{7,}$"


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regex of the whole string: * any run, ? one character, [...] a set."""
    parts = re.split(r"(\*|\?|\[[!^]?\]?[^\]]*\])", pattern)
    sign = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(sign.get(p) or (f"[{'^' if p[1] in '!^' else ''}{p[1:-1].lstrip('!^')}]" if i % 2 else re.escape(p)) for i, p in enumerate(parts)) + "$"


def matches(tool: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | tool.rlike(glob_regex(g))
    return found


def gate(calls: DataFrame, allow: list[str], deny: list[str], cap: str, not_before: str, not_after: str) -> DataFrame:
    """Adds `reason` to calls (session, seq, tool, amount text, ts): the first rule that a call breaks, or inside.

    An amount that can't be read is a could-not-look, never a pass.
    """
    amount = F.col("amount").try_cast("decimal(38,2)")
    reason = (
        F.when(F.col("ts") < F.lit(not_before).cast("timestamp_ntz"), "before_window")
        .when(F.col("ts") > F.lit(not_after).cast("timestamp_ntz"), "after_window")
        .when(matches(F.col("tool"), deny), "denied")
        .when(~matches(F.col("tool"), allow) if allow else F.lit(False), "not_allowed")
        .when(amount.isNull(), "unreadable_amount")
        .when(amount > F.lit(cap).cast("decimal(38,2)"), "over_cap")
        .otherwise("inside")
    )
    return calls.withColumn("reason", reason)


def session_spend(gated: DataFrame, total: int) -> DataFrame:
    """Enforced totals: `verdict` (forwarded, over_total or the gate's reason) and `spent`, the session's forwarded spend so far.

    Blocked calls spend nothing. Sessions whose inside calls stay within the
    total need a running sum only; the others are folded in order, as each
    answer there depends on the ones before.
    """
    money = F.when(F.col("reason") == "inside", F.col("amount").cast("decimal(38,2)")).otherwise(F.lit(0).cast("decimal(38,2)"))
    rows = gated.withColumn("cents", (money * 100).cast("long"))
    sums = rows.groupBy("session").agg((F.sum("cents") > total * 100).alias("tight"))
    rows = rows.join(sums, "session")
    so_far = F.sum("cents").over(Window.partitionBy("session").orderBy("seq"))
    easy = rows.where(~F.col("tight")).select("session", "seq", F.when(F.col("reason") == "inside", "forwarded").otherwise(F.col("reason")).alias("verdict"), so_far.alias("spent"))

    def step(spent: int, row: dict) -> tuple[int, tuple]:
        if row["reason"] != "inside":
            return spent, (row["reason"], spent)
        now = spent + row["cents"]
        return (now, ("forwarded", now)) if now <= total * 100 else (spent, ("over_total", spent))

    added = T.StructType([T.StructField("verdict", T.StringType()), T.StructField("spent", T.LongType())])
    hard = ordered_fold(rows.where("tight").select("session", "seq", "reason", "cents"), ["session"], ["seq"], lambda: 0, step, added)
    return easy.unionAll(hard.select("session", "seq", "verdict", "spent"))


def last_session(rows: DataFrame, session: str, order: str) -> DataFrame:
    """The rows of the session that the last row belongs to."""
    last = rows.agg(F.max_by(session, order).alias("_last"))
    return rows.join(F.broadcast(last), rows[session] == F.col("_last"), "left_semi")


def mandate_totals(rows: DataFrame) -> DataFrame:
    """(mode, sessions, allowed, blocked, newest) of session_end rows (mode, session, line, allowed, blocked)."""
    return rows.groupBy("mode").agg(F.countDistinct("session").alias("sessions"), F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"), F.max_by("session", "line").alias("newest"))


def windowed_counts(ended: DataFrame, gated: DataFrame) -> DataFrame:
    """One row: inside calls summed from session_end rows, outside and could-not-look calls counted, sessions without an end."""
    sums = ended.agg(F.coalesce(F.sum("inside"), F.lit(0)).alias("inside"))
    other = gated.agg(F.count_if(F.col("verdict") == "outside").alias("outside"), F.count_if(F.col("verdict") == "could_not_look").alias("could_not_look"))
    open_ended = gated.select("session").distinct().join(ended.select("session"), "session", "left_anti").agg(F.count("*").alias("unended"))
    return sums.crossJoin(other).crossJoin(open_ended)  # three single rows


def ceiling(calls: DataFrame, month: str, limit: float, warn: float = 0.8) -> DataFrame:
    """One row of a month's spend: pins, billable, sum (null: no cost row at all, not zero), pct and ok/warn/red."""
    rows = calls.where(F.col("month") == month)
    total = F.sum("cost")
    pct = F.round(total / limit * 100, 2)
    word = F.when(total.isNull(), "absent").when(total >= limit, "red").when(total >= warn * limit, "warn").otherwise("ok")
    return rows.agg(F.count("*").alias("pins"), F.count_if(F.col("cost") > 0).alias("billable"), total.alias("total"), pct.alias("pct"), word.alias("level"))


def usage_of(usage: DataFrame, roster: DataFrame, prefix: str) -> DataFrame:
    """(key, month, used) of the one key with this hash prefix; an error row (null key) where it is too short, unknown or ambiguous."""
    met = roster.where(F.col("hash").startswith(prefix.lower()))
    n = met.agg(F.count("*").alias("n"), F.min("key").alias("key"))
    error = F.when(F.lit(len(prefix) < 6), "prefix_too_short").when(F.col("n") == 0, "unknown").when(F.col("n") > 1, "ambiguous")
    one = n.select("key", error.alias("error"))
    good = one.where("error is null").join(usage, "key").select("key", "month", "used", F.lit(None).cast("string").alias("error"))
    return good.unionAll(one.where("error is not null").select(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("long"), "error"))


def first_active(rows: DataFrame, name: str, order: str) -> DataFrame:
    """The first row of each name among latest, active rows."""
    return rows.where("is_latest and status = 'active'").withColumn("_k", F.row_number().over(Window.partitionBy(name).orderBy(order))).where("_k = 1").drop("_k")


def typed_totals(edits: DataFrame) -> DataFrame:
    """(session, typed, pasted, deleted, pasted_share, first, last); the share is null where nothing was put in."""
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("chars"))), F.lit(0))
    sums = edits.groupBy("session").agg(n("type").alias("typed"), n("paste").alias("pasted"), n("delete").alias("deleted"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    put = F.col("typed") + F.col("pasted")
    return sums.withColumn("pasted_share", F.when(put > 0, F.round(F.col("pasted") / put, 3)))


def chain_and_witness(chain_ok: Column, witness: Column) -> Column:
    """One verdict of a chain's and a witness's: damage before rewriting, both before could-not-look."""
    return F.when(~chain_ok, "damaged").when(witness.isin("rewritten", "truncated"), witness).when(chain_ok.isNull() | witness.isNull() | (witness == "no_record"), "could_not_look").otherwise("consistent")


def lint_mandate(rows: DataFrame) -> DataFrame:
    """(id, problems) of mandates (id, cap text, currency, not_before, not_after texts): the fields that can't be used, in order."""
    start, end = F.try_to_timestamp("not_before"), F.try_to_timestamp("not_after")
    cap = F.col("cap").try_cast("decimal(38,18)")
    checks = [
        F.when(F.col("cap").isNotNull() & cap.isNull(), "cap_unreadable").when(cap < 0, "cap_negative"),
        F.when(F.col("currency").isNull() | ~F.col("currency").rlike("^[A-Z]{3}$"), "currency"),
        F.when(F.col("not_before").isNotNull() & start.isNull(), "not_before_unreadable"),
        F.when(F.col("not_after").isNotNull() & end.isNull(), "not_after_unreadable").when(end < start, "window_empty"),
    ]
    return rows.select("id", F.array_join(F.array_compact(F.array(*checks)), ",").alias("problems"))


def looks_like_phone(name: Column) -> Column:
    """Participant ids may not be telephone numbers."""
    return name.rlike(PHONE)


def duration(start: Column, end: Column) -> Column:
    """Whole and broken seconds; null where the end lies before the start or either is missing."""
    seconds = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    return F.when(seconds >= 0, seconds)


def plain_lines(text: Column) -> Column:
    """CRLF and CR become LF, and blanks at both ends go."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "^[ \t\n]+|[ \t\n]+$", "")
