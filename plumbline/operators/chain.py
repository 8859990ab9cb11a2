"""Hash chains over ledgers: build, verify, heads, declared breaks.

A ledger is rows (ledger_id, line, body, chain). The chain value of a row is the
first 32 hex digits of sha256(previous chain value + body), the first one's
previous value being "genesis". Verification goes on from each row's claimed
value, so every row can be checked on its own once it knows the last claim
before it; building has to go row by row within a ledger.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.canon import GENESIS, LINK
from plumbline.functions.fold import column_fold


def linked(previous: Column, body: Column) -> Column:
    return F.substring(F.sha2(F.concat(previous, body), 256), 1, LINK)


def build(rows: DataFrame) -> DataFrame:
    """Adds `chain` to rows (ledger_id, line, body, ...), one ledger after its own order.

    A fold per ledger, streamed in order of line: a ledger may be larger than
    memory, but one ledger's rows are hashed one after the other, as a chain
    has to be.
    """

    def step(previous: str, body: str) -> tuple[str, tuple]:
        now = hashlib.sha256((previous + body).encode()).hexdigest()[:LINK]
        return now, (now,)

    return column_fold(rows, ["ledger_id"], ["line"], ["body"], lambda: GENESIS, step, T.StructType([T.StructField("chain", T.StringType())]))


def carried(rows: DataFrame, key: str, order: str, value: str, out: str, chunk: int = 1 << 16) -> DataFrame:
    """Adds `out`: the last non-null `value` on an earlier row of the key.

    Rows are cut into chunks of the order column, so a key with very many rows
    is many tasks; only each chunk's last value goes from chunk to chunk.
    """
    cut = rows.withColumn("_chunk", F.floor(F.col(order) / chunk))
    ends = cut.groupBy(key, "_chunk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(key, "_chunk", before.alias("_before"))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("_inside", inside).join(ends, [key, "_chunk"]).withColumn(out, F.coalesce("_inside", "_before")).drop("_chunk", "_inside", "_before")


def checked(rows: DataFrame, declared: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """One row a line with `kind`: ok, break, prechain or declared; and `want`, the value it should claim.

    rows: ledger_id, line, body, chain (null: unchained), raw. declared:
    (ledger_id, line, raw_sha256, resume_prev), the last declaration of a line
    counting, and only if it names the bytes the line has.
    """
    if declared is None or strict:
        rows = rows.withColumn("excused", F.lit(False)).withColumn("resume", F.lit(None).cast("string"))
    else:
        d = declared.select("ledger_id", "line", "raw_sha256", F.coalesce("resume_prev", F.lit(GENESIS)).alias("resume"))
        rows = rows.join(d, ["ledger_id", "line"], "left").withColumn("excused", F.coalesce(F.sha2("raw", 256) == F.col("raw_sha256"), F.lit(False))).drop("raw_sha256")
    first = rows.groupBy("ledger_id").agg(F.min(F.when(F.col("chain").isNotNull(), F.col("line"))).alias("first_chained"))
    rows = rows.join(first, "ledger_id")
    started = F.coalesce(F.col("first_chained") < F.col("line"), F.lit(False))
    out = F.when(F.col("chain").isNotNull(), F.col("chain")).when(started & F.col("excused"), F.col("resume"))
    rows = carried(rows.withColumn("started", started).withColumn("out", out), "ledger_id", "line", "out", "previous")
    want = linked(F.coalesce("previous", F.lit(GENESIS)), F.col("body"))
    bad = F.when(F.col("excused"), "declared").otherwise("break")
    kind = F.when(F.col("chain").isNull() & ~F.col("started"), F.lit("break" if strict else "prechain")).when(F.col("chain").isNull(), bad).when(F.coalesce(F.col("chain") == want, F.lit(False)), "ok").otherwise(bad)
    return rows.select("ledger_id", "line", "chain", want.alias("want"), kind.alias("kind"))


def verify(rows: DataFrame, declared: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """One verdict a ledger: ok (null: could not look at all of it), counts, first break, scope."""
    lines = checked(rows, declared, strict)
    n = lambda k: F.count_if(F.col("kind") == k)
    sums = lines.groupBy("ledger_id").agg(
        F.count("*").alias("rows"),
        F.count("chain").alias("chained"),
        n("prechain").alias("prechain"),
        n("break").alias("breaks"),
        n("declared").alias("declared_breaks"),
        F.min(F.when(F.col("kind") == "break", F.col("line"))).alias("first_break"),
    )
    bounded = F.array_compact(F.array(F.when(F.col("prechain") > 0, "prechain_skipped"), F.when(F.col("declared_breaks") > 0, "declared_break")))
    scope = F.when(F.size(bounded) > 0, F.concat(F.lit("bounded_"), F.array_join(bounded, "+"))).otherwise("full")
    ok = F.when(F.col("breaks") > 0, False).when(F.size(bounded) > 0, F.lit(None).cast("boolean")).otherwise(True)
    return sums.withColumn("scope", scope).withColumn("ok", ok)


def heads(rows: DataFrame) -> DataFrame:
    """(ledger_id, rows, head): the last row's chain, "genesis" if it has none."""
    return rows.groupBy("ledger_id").agg(F.count("*").alias("rows"), F.coalesce(F.max_by("chain", "line"), F.lit(GENESIS)).alias("head"))


def chain_at(rows: DataFrame, n: int) -> DataFrame:
    """(ledger_id, chain) at each ledger's n-th row; "genesis" for n of 0 or less, nothing beyond the end."""
    if n <= 0:
        return rows.select("ledger_id").distinct().withColumn("chain", F.lit(GENESIS))
    place = F.row_number().over(Window.partitionBy("ledger_id").orderBy("line"))
    return rows.withColumn("n", place).where(F.col("n") == n).select("ledger_id", F.coalesce("chain", F.lit(GENESIS)).alias("chain"))


def last_declared(declarations: DataFrame) -> DataFrame:
    """Of several declarations for one line the last counts."""
    return declarations.groupBy("ledger_id", "orphan_line").agg(F.max_by(F.struct("raw_sha256", "resume_prev", "why"), "line").alias("d")).select("ledger_id", F.col("orphan_line").alias("line"), "d.*")


def chained_lines(lines: DataFrame) -> DataFrame:
    """Adds `prev_hash`, the sha256 of the line before ("genesis" first), to (ledger_id, line, raw)."""
    before = F.lag("raw").over(Window.partitionBy("ledger_id").orderBy("line"))
    return lines.withColumn("prev_hash", F.coalesce(F.sha2(before, 256), F.lit(GENESIS)))
