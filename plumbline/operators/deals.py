"""Deals kept by both sides: rows (deal, step, pos, fields), and the handshake before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The steps of a deal, in order.
STEPS = ("mandate", "commit", "ship", "receive", "cancel", "dispute")


def compare(buyer: DataFrame, seller: DataFrame, fields: list[str]) -> DataFrame:
    """The i-th row of a step on either side: same, differs (which fields), or missing on a side."""
    place = F.row_number().over(Window.partitionBy("deal", "step").orderBy("pos"))
    b = buyer.withColumn("nth", place).select("deal", "step", "nth", F.struct(*fields).alias("b"))
    s = seller.withColumn("nth", place).select("deal", "step", "nth", F.struct(*fields).alias("s"))
    both = b.join(s, ["deal", "step", "nth"], "full")
    differs = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"s.{f}")), F.lit(f)) for f in fields])), ",")
    finding = F.when(F.col("s").isNull(), "missing_on_seller").when(F.col("b").isNull(), "missing_on_buyer").when(differs != "", "differs").otherwise("same")
    return both.select("deal", "step", F.col("nth").cast("long").alias("nth"), finding.alias("finding"), F.when(finding == "differs", differs).alias("fields"))


def verdicts(findings: DataFrame) -> DataFrame:
    """A deal's verdict, the worst of its findings: DIFFERS, MISSING, AGREED."""
    n = lambda p: F.count_if(F.col("finding").rlike(p))
    word = F.when(n("differs") > 0, "DIFFERS").when(n("missing") > 0, "MISSING").otherwise("AGREED")
    return findings.groupBy("deal").agg(word.alias("verdict"), n("differs").alias("differing"), n("missing").alias("missing"), F.count("*").alias("rows"))


def pin_bound(rows: DataFrame, pins: DataFrame) -> DataFrame:
    """Each row's (party, n) earliest stamp of a pin (party, rows, as_of) that covers it: pin.rows >= n.

    Instead of a join on the range: the earliest stamp of all pins at this
    count or above, by a window over rows and pins together.
    """
    both = rows.select("party", F.col("n").alias("at"), F.lit(1).alias("is_row"), F.lit(None).cast("string").alias("as_of")).unionAll(pins.select("party", F.col("rows").alias("at"), F.lit(0).alias("is_row"), "as_of"))
    down = Window.partitionBy("party").orderBy(F.desc("at"), "is_row")
    return both.withColumn("bound", F.min("as_of").over(down.rowsBetween(Window.unboundedPreceding, 0))).where("is_row = 1").select("party", F.col("at").alias("n"), "bound")


def position(timeline: DataFrame) -> DataFrame:
    """Of each deal (deal, step, ts): whether a cancel came before the ship, and the minutes between, half to even."""
    at = lambda s: F.min(F.when(F.col("step") == s, F.col("ts")))
    wide = timeline.groupBy("deal").agg(at("cancel").alias("cancel"), at("ship").alias("ship"))
    seconds = F.unix_seconds(F.col("ship").cast("timestamp")) - F.unix_seconds(F.col("cancel").cast("timestamp"))
    minutes = F.bround(seconds / 60, 0).cast("long")
    word = F.when(F.col("cancel").isNull(), "not_cancelled").when(F.col("ship").isNull(), "not_shipped").when(F.col("cancel") < F.col("ship"), "cancelled_before_ship").otherwise("cancelled_after_ship")
    return wide.select("deal", word.alias("position"), minutes.alias("minutes"))


def handshake(proposals: DataFrame, acceptances: DataFrame) -> DataFrame:
    """Verdict by id of the last proposal (id, pos, terms, row) and the last acceptance (id, pos, terms, cited_row)."""
    p = proposals.groupBy("id").agg(F.max_by(F.struct("terms", "row"), "pos").alias("p"))
    a = acceptances.groupBy("id").agg(F.max_by(F.struct("terms", "cited_row"), "pos").alias("a"))
    word = (
        F.when(F.col("p").isNull() | F.col("a").isNull(), "MISSING")
        .when(F.col("p.terms").isNull() | F.col("a.terms").isNull(), "COULD_NOT_LOOK")
        .when(F.col("p.terms") != F.col("a.terms"), "DIFFERENT_TERMS")
        .when(~F.col("p.row").eqNullSafe(F.col("a.cited_row")), "COULD_NOT_LOOK")
        .otherwise("AGREED_TERMS")
    )
    return p.join(a, "id", "full").select("id", word.alias("verdict"))
