"""Roll-ups over logs: summaries, open items, states, rates, mandates, pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the 95 % point of the normal distribution.
Z = 1.959964


def summary(rows: DataFrame) -> DataFrame:
    """By event (null: "?"): count, and first and last ts as text, compared as text."""
    return rows.groupBy(F.coalesce("event", F.lit("?")).alias("event")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def still_open(rows: DataFrame, code: int) -> DataFrame:
    """Targets whose newest row (by line) left with `code`."""
    newest = rows.groupBy("target").agg(F.max_by(F.struct("line", "code"), "line").alias("r")).select("target", "r.*")
    return newest.where(F.col("code") == code).select("target", "line")


def latest_states(rows: DataFrame) -> DataFrame:
    """State of each key from intents and executions (key, line, kind): a later intent resets it."""
    marks = rows.groupBy("key").agg(F.max(F.when(F.col("kind") == "intent", F.col("line"))).alias("intent"), F.max(F.when(F.col("kind") == "executed", F.col("line"))).alias("executed"))
    done = F.coalesce(F.col("executed") > F.coalesce("intent", F.lit(-1)), F.lit(False))
    return marks.select("key", F.when(done, "executed").otherwise("intent").alias("state"), "intent", F.when(done, F.col("executed")).alias("executed"))


def first_claims(rows: DataFrame) -> DataFrame:
    """(key, line): the first row that claims each key."""
    return rows.groupBy("key").agg(F.min("line").alias("line"))


def scores(items: DataFrame) -> DataFrame:
    """By type, and over all as "(all)": n, n_scored, sum and mean of the scores; null scores don't count."""
    groups = items.groupingSets([["type"], []], "type").agg(F.grouping("type").alias("_all"), F.count("*").alias("n"), F.count("score").alias("n_scored"), F.sum("score").alias("sum"), F.round(F.avg("score"), 6).alias("mean"))
    return groups.select(F.when(F.col("_all") == 1, "(all)").otherwise(F.col("type")).alias("type"), "n", "n_scored", "sum", "mean")


def nearest_rank(rows: DataFrame, key: str, value: str, q: float) -> DataFrame:
    return rows.groupBy(key).agg(F.expr(f"percentile_disc({q}) within group (order by {value})").alias("pctl"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % score interval of k out of n, within 0 and 1; null for n of 0."""
    p, z2 = F.try_divide(k, n), Z * Z
    middle = F.try_divide(p + F.try_divide(F.lit(z2), 2 * n), 1 + F.try_divide(F.lit(z2), n))
    half = F.try_divide(Z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n)), 1 + F.try_divide(F.lit(z2), n))
    bound = lambda x: F.when(n > 0, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return bound(middle - half), bound(middle + half)


def bucket_counts(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows in each listed bucket, zero where there are none."""
    found = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    return buckets.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def one_of(value: Column, none: str = "none") -> Column:
    """The single value of a group, "(mixed) a; b" of several, or a word for none."""
    found = F.array_sort(F.collect_set(value))
    return F.when(F.size(found) == 0, none).when(F.size(found) == 1, F.element_at(found, 1)).otherwise(F.concat(F.lit("(mixed) "), F.array_join(found, "; ")))


def access_register(entries: DataFrame) -> DataFrame:
    """For each (kind, digest): how many calls name it, the first call, and its distinct tools."""
    return entries.groupBy("kind", "digest").agg(F.countDistinct("call").alias("calls"), F.min("call").alias("first_call"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))


def mandate_check(terms: DataFrame) -> DataFrame:
    """(id, ok, reason): merchant, currency, cap, then window; ok is null where an amount or time can't be read."""
    amount = F.expr("try_cast(amount as decimal(38, 2))")
    at = F.expr("try_cast(at as timestamp)")
    reason = (
        F.when(F.col("merchant") != F.col("allowed_merchant"), "merchant")
        .when(F.col("currency") != F.col("allowed_currency"), "currency")
        .when(amount.isNull(), "amount_unreadable")
        .when(amount > F.col("cap"), "cap")
        .when(at.isNull(), "time_unreadable")
        .when((at < F.col("not_before")) | (at > F.col("not_after")), "window")
    )
    ok = F.when(reason.isNull(), True).when(reason.endswith("unreadable"), F.lit(None).cast("boolean")).otherwise(False)
    return terms.select("id", ok.alias("ok"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def pairs(rows: DataFrame) -> DataFrame:
    """Each call (scope, id, pos, kind) with the answer it gets: an answer takes the oldest open call.

    An answer without an open call is stray. With calls as +1 and answers as -1
    the strays are the answers at which the running sum reaches a new low below
    zero; after they are gone, the n-th answer belongs to the n-th call.
    """
    by = Window.partitionBy("scope", "id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col("kind") == "call", 1).otherwise(-1)).over(by)
    low = rows.withColumn("_depth", depth).withColumn("_low", F.min(F.least("_depth", F.lit(0))).over(by))
    before = F.coalesce(F.lag("_low").over(Window.partitionBy("scope", "id").orderBy("pos")), F.lit(0))
    kept = low.withColumn("_stray", (F.col("kind") == "answer") & (F.col("_low") < before)).where("not _stray")
    nth = F.row_number().over(Window.partitionBy("scope", "id", "kind").orderBy("pos"))
    kept = kept.withColumn("nth", nth)
    calls = kept.where("kind = 'call'").select("scope", "id", "nth", F.col("pos").alias("call"))
    answers = kept.where("kind = 'answer'").select("scope", "id", "nth", F.col("pos").alias("answer"))
    return calls.join(answers, ["scope", "id", "nth"], "left").select("scope", "id", "call", "answer")


def in_window(rows: DataFrame, since: str, until: str) -> DataFrame:
    """rows (ts as text) with `placed`: in, out (both ends belong to the window), or unplaced if ts can't be read."""
    at = F.expr("try_cast(ts as timestamp)")
    inside = (at >= F.lit(since).cast("timestamp")) & (at <= F.lit(until).cast("timestamp"))
    return rows.withColumn("placed", F.when(at.isNull(), "unplaced").when(inside, "in").otherwise("out"))
