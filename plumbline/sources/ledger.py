"""Ledgers and other line files, with exact line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.rows import read_rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ledger_id, line, raw) of every line; lines end at LF only and count from 1.

    Spark's reader finds the line starts, so a file may be larger than a task;
    numbers come from the lines before each part of a file. The part after the
    last LF is a line only if it isn't empty.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("ledger_id"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    inside = F.row_number().over(Window.partitionBy("ledger_id", "part").orderBy("id"))
    sizes = text.groupBy("ledger_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("ledger_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return text.withColumn("k", inside).join(sizes.withColumn("before", before), ["ledger_id", "part"]).select("ledger_id", (F.col("k") + F.col("before")).alias("line"), "raw")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its number, its text and how it reads (see operators.rows). Bad lines are rows, not errors."""
    return read_rows(read_lines(spark, path))
