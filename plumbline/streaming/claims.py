"""Streams: exactly-once claims and running totals with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_claims(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; a repeat within `delay` of it is dropped. Columns: key, ts (timestamp), any others."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])


def windowed_counts(stream: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, event, n): rows of each event in each window, complete once the watermark has passed it."""
    counts = stream.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event", "n")
