"""Metered usage under monthly caps, and rosters of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.fold import ordered_fold


def caps(roster: DataFrame, defaults: dict[str, int | None]) -> DataFrame:
    """(key, unlimited, cap) of roster rows (key, plan, has_cap, cap).

    A stated null is no limit; a stated negative number, or an unknown plan
    without a stated cap, grants nothing. Without a stated cap the plan decides.
    """
    free = [p for p, c in defaults.items() if c is None]
    table = F.create_map(*[F.lit(x) for p, c in defaults.items() if c is not None for x in (p, c)])
    unlimited = F.when(F.col("has_cap"), F.col("cap").isNull()).otherwise(F.coalesce(F.col("plan").isin(free), F.lit(False)))
    stated = F.when(F.col("has_cap"), F.when(F.col("cap") >= 0, F.col("cap"))).otherwise(F.try_element_at(table, F.coalesce("plan", F.lit(""))))
    return roster.select("key", unlimited.alias("unlimited"), F.coalesce(stated, F.lit(0)).cast("long").alias("cap"))


def grants(calls: DataFrame, limits: DataFrame) -> DataFrame:
    """calls (key, month, seq, cost) with `granted` and `used` after the call.

    A call is granted if what was granted before and its own cost stay within
    the cap; a denied call uses nothing, so a running sum would be wrong.
    Calls of a key that has no limits row are denied. One month of one key is
    streamed in order.
    """
    rows = calls.join(limits, "key", "left")

    def step(used: int, row: dict) -> tuple[int, tuple]:
        granted = bool(row["unlimited"]) or (row["cap"] is not None and used + row["cost"] <= row["cap"])
        used += row["cost"] * granted
        return used, (granted, used)

    schema = T.StructType([T.StructField("granted", T.BooleanType()), T.StructField("used", T.LongType())])
    return ordered_fold(rows, ["key", "month"], ["seq"], lambda: 0, step, schema)


def usage_report(roster: DataFrame, usage: DataFrame) -> DataFrame:
    """Every roster key with its usage, zero where there is none; usage of unknown keys stays out."""
    sums = usage.groupBy("key").agg(F.sum("used").alias("used"))
    return roster.select("key", "plan").join(sums, "key", "left").select("key", "plan", F.coalesce("used", F.lit(0)).cast("long").alias("used"))


def orphans(roster: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: how many usage rows, and how much usage, no roster key owns."""
    lost = usage.join(roster.select("key"), "key", "left_anti")
    return lost.agg(F.count("*").alias("rows"), F.coalesce(F.sum("used"), F.lit(0)).cast("long").alias("used"))


def migrate(usage: DataFrame, roster: DataFrame, width: int) -> DataFrame:
    """Usage under short keys, moved to the one roster key that begins so; else kept as legacy:key."""
    owners = roster.groupBy(F.substring("key", 1, width).alias("short")).agg(F.min("key").alias("owner"), F.count("*").alias("n"))
    met = usage.withColumnRenamed("key", "short").join(owners.where("n = 1"), "short", "left")
    return met.select(F.coalesce("owner", F.concat(F.lit("legacy:"), "short")).alias("key"), "used").groupBy("key").agg(F.sum("used").alias("used"))


def revoke(roster: DataFrame, prefix: str) -> DataFrame:
    """The roster with `revoked` set on the one key that begins with prefix; unchanged if none or several do."""
    hit = roster.where(F.col("key").startswith(prefix)).agg(F.min("key").alias("_hit"), F.count("*").alias("_n"))
    one = hit.select(F.when(F.col("_n") == 1, F.col("_hit")).alias("_hit"))
    return roster.crossJoin(F.broadcast(one)).withColumn("revoked", F.col("revoked") | F.coalesce(F.col("key") == F.col("_hit"), F.lit(False))).drop("_hit")
