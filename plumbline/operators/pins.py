"""Pins: external checkpoints of a ledger, and what they say about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.canon import GENESIS

#: Hex digits of a link, seconds a pin may be ahead of its receipt, rows until a pin is stale.
CHAIN = f"\\A(?:{GENESIS}|[0-9a-f]{{32}})\\z"
AHEAD_S, STALE_ROWS = 300, 100


def strict(rows: Column, chain: Column, namespace: Column) -> Column:
    """Whether a pin has the shape of one: rows >= 0, a link or genesis, a namespace."""
    return F.coalesce((rows >= 0) & F.lower(chain).rlike(CHAIN) & (F.length(F.trim(namespace)) > 0), F.lit(False))


def accepted(pins: DataFrame) -> DataFrame:
    """Each pin (namespace, line, rows, chain, as_of, received_at) with `reason`, null if it is taken.

    In this order: malformed; behind the highest count taken before; another
    chain at a count that has one; stamped too far ahead of its receipt.
    """
    ahead = F.col("as_of").cast("timestamp") > F.col("received_at").cast("timestamp") + F.expr(f"interval {AHEAD_S} seconds")
    shaped = pins.withColumn("shape", strict(F.col("rows"), F.col("chain"), F.col("namespace"))).withColumn("ahead", F.coalesce(ahead, F.lit(False)))
    counts = F.col("shape") & ~F.col("ahead")
    earlier = Window.partitionBy("namespace").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    high = F.max(F.when(counts, F.col("rows"))).over(earlier)
    rising = shaped.withColumn("high", F.coalesce(high, F.lit(-1))).withColumn("rising", F.col("rows") >= F.col("high"))
    same = Window.partitionBy("namespace", "rows").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first(F.when(counts & F.col("rising"), F.lower("chain")), ignorenulls=True).over(same)
    reason = F.when(~F.col("shape"), "malformed").when(~F.col("rising"), "behind").when(F.coalesce(first != F.lower("chain"), F.lit(False)), "equivocation").when(F.col("ahead"), "ahead")
    return rising.withColumn("reason", reason).select(*pins.columns, "reason")


def latest(pins: DataFrame) -> DataFrame:
    return pins.groupBy("namespace").agg(F.max_by(F.struct("rows", "chain", "line"), "line").alias("p")).select("namespace", "p.*")


def history(pins: DataFrame, namespace: str) -> DataFrame:
    return pins.where(F.col("namespace") == namespace).orderBy("line")


def equivocal(pins: DataFrame) -> DataFrame:
    """(namespace, rows): the first count that two chains were pinned at."""
    twice = pins.groupBy("namespace", "rows").agg(F.countDistinct(F.lower("chain")).alias("n")).where("n > 1")
    return twice.groupBy("namespace").agg(F.min("rows").alias("rows"))


def compare(pins: DataFrame, rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each namespace's verdict, the worst of its pins: what the log has at each pin's row count.

    rows: ledger_id, line, chain; verdicts: ledger_id, ok, as verify gives. In
    this order: local_broken, no_record, truncated, rewritten, consistent. A
    pin of no rows, or one of genesis over an unchained row, can't be compared.
    """
    place = F.row_number().over(Window.partitionBy("ledger_id").orderBy("line"))
    numbered = rows.select(F.col("ledger_id").alias("namespace"), place.alias("rows"), F.col("chain").alias("local"))
    met = pins.select("namespace", "rows", F.lower("chain").alias("chain")).join(numbered, ["namespace", "rows"], "left")
    sizes = rows.groupBy(F.col("ledger_id").alias("namespace")).agg(F.count("*").alias("n_rows"))
    met = met.join(sizes, "namespace", "left")
    finding = F.when(F.col("rows") == 0, "no_record").when(F.coalesce("n_rows", F.lit(0)) < F.col("rows"), "truncated").when(F.col("local").isNull(), "no_record").when(F.col("local") != F.col("chain"), "rewritten").otherwise("consistent")
    counts = met.groupBy("namespace").agg(*[F.count_if(finding == w).alias(w) for w in ("truncated", "rewritten", "consistent")], F.count("*").alias("pins"))
    whole = verdicts.select(F.col("ledger_id").alias("namespace"), "ok").join(counts, "namespace", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    word = F.when(~F.coalesce("ok", F.lit(True)), "local_broken").when(n("pins") == 0, "no_record").when(n("truncated") > 0, "truncated").when(n("rewritten") > 0, "rewritten").when(n("consistent") > 0, "consistent").otherwise("no_record")
    return whole.select("namespace", n("pins").alias("pins"), word.alias("verdict"))


def against_witness(pins: DataFrame, files: DataFrame, rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(namespace, pins, verdict, witness) of each log against all pins that its witness holds.

    pins: namespace, line, rows, chain, none left out; files: (namespace, ok)
    what the pin file's own chain says, null or absent where that couldn't be
    told. Before anything is compared, in this order: witness_broken (the file
    fails its chain, and holds pins), witness_unreadable (one pin hasn't the
    shape of one, so none is trusted), local_broken, witness_broken (two chains
    at one row count); then as in `compare`. witness: verified, broken or
    unestablished.
    """
    shaped = pins.withColumn("fine", strict(F.col("rows"), F.col("chain"), F.col("namespace")))
    odd = shaped.groupBy("namespace").agg((F.count_if(~F.col("fine")) > 0).alias("unreadable"))
    twice = equivocal(shaped.where("fine and rows > 0")).select("namespace", F.lit(True).alias("twice"))
    own = files.groupBy("namespace").agg(F.min("ok").alias("file_ok"))
    base = compare(shaped.where("fine").select(pins.columns), rows, verdicts)
    held = pins.groupBy("namespace").agg(F.count("*").alias("held"))
    met = base.join(odd, "namespace", "left").join(twice, "namespace", "left").join(own, "namespace", "left").join(held, "namespace", "left")
    broken = ~F.coalesce("file_ok", F.lit(True)) & (F.coalesce("held", F.lit(0)) > 0)
    word = (
        F.when(broken, "witness_broken")
        .when(F.coalesce("unreadable", F.lit(False)), "witness_unreadable")
        .when(F.col("verdict") == "local_broken", "local_broken")
        .when(F.coalesce("twice", F.lit(False)), "witness_broken")
        .otherwise(F.col("verdict"))
    )
    witness = F.when(F.col("file_ok").isNull(), "unestablished").when(F.col("file_ok"), "verified").otherwise("broken")
    return met.select("namespace", F.coalesce("held", F.lit(0)).alias("pins"), word.alias("verdict"), witness.alias("witness"))


def gaps(pins: DataFrame, rows: DataFrame, limit: int = STALE_ROWS) -> DataFrame:
    """(namespace, gap, stale): rows past each namespace's latest pin; below zero if the log is shorter."""
    sizes = rows.groupBy(F.col("ledger_id").alias("namespace")).agg(F.count("*").alias("n"))
    gap = F.coalesce("n", F.lit(0)) - F.col("rows")
    return latest(pins).join(sizes, "namespace", "left").select("namespace", gap.alias("gap"), (gap > limit).alias("stale"))
