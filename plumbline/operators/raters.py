"""Readings of claims by raters, snapshots, gates and citations: comparisons by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.textual import folded

#: What a reading may say; below so many compared claims a rate says little yet.
READINGS, INFORMATIVE = ("yes", "no", "undetermined"), 20


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def canonical_reader(name: Column) -> Column:
    """Reader ids that differ by case, blanks or compatibility forms alone are one reader."""
    return F.trim(folded(name))


def parse_answer(answer: Column) -> Column:
    """The first word decides: yes, no, or undetermined."""
    first = F.lower(F.regexp_extract(answer, "^\\s*([A-Za-z]+)", 1))
    return F.when(first.isin("yes", "no"), first).otherwise("undetermined")


def citation_order(criteria: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings (ledger, line, sha) and whether they cite a criterion frozen on an earlier line of their ledger."""
    first = criteria.groupBy("ledger", "sha").agg(F.min("line").alias("frozen"))
    return readings.join(first, ["ledger", "sha"], "left").select("ledger", "line", "sha", F.coalesce(F.col("frozen") < F.col("line"), F.lit(False)).alias("cited"))


def compare_readings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Status by claim of two raters' latest readings (claim_id, claim_sha, criterion_sha, reader, reading)."""
    left = a.select("claim_id", *[F.col(c).alias(f"a_{c}") for c in ("claim_sha", "criterion_sha", "reader", "reading")])
    right = b.select("claim_id", *[F.col(c).alias(f"b_{c}") for c in ("claim_sha", "criterion_sha", "reader", "reading")])
    status = (
        F.when(F.col("a_reading").isNull() | F.col("b_reading").isNull(), "MISSING")
        .when(F.col("a_claim_sha") != F.col("b_claim_sha"), "COULD_NOT_LOOK_TEXT")
        .when(F.col("a_criterion_sha") != F.col("b_criterion_sha"), "COULD_NOT_LOOK_CRITERION")
        .when(canonical_reader(F.col("a_reader")) == canonical_reader(F.col("b_reader")), "COULD_NOT_LOOK_SAME_READER")
        .when(F.col("a_reading") == F.col("b_reading"), "AGREED")
        .otherwise("DISAGREED")
    )
    return left.join(right, "claim_id", "full").select("claim_id", status.alias("status"))


def summarize_statuses(statuses: DataFrame) -> DataFrame:
    """Counts, the agreed share of what could be compared (null of none), and whether it says much yet."""
    n = lambda *w: F.count_if(F.col("status").isin(*w))
    compared = n("AGREED", "DISAGREED")
    share = F.when(compared > 0, F.round(n("AGREED") / compared, 6))
    cnl = F.count_if(F.col("status").startswith("COULD_NOT_LOOK"))
    return statuses.agg(F.count("*").alias("claims"), n("AGREED").alias("agreed"), n("DISAGREED").alias("disagreed"), n("MISSING").alias("missing"), cnl.alias("could_not_look"), share.alias("fraction"), (compared < INFORMATIVE).alias("not_yet_informative"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change) of two snapshots (id, value): changed, added, removed or unchanged."""
    b, a = before.select("id", F.col("value").alias("old"), F.lit(True).alias("was")), after.select("id", F.col("value").alias("new"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return b.join(a, "id", "full").select("id", change.alias("change"))


def added_fields(manifest: DataFrame, sealed: DataFrame) -> DataFrame:
    """Ids of the manifest (field, id) that the seal lacks, by field, in order."""
    return manifest.join(sealed.select("id"), "id", "left_anti").groupBy("field").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("field", F.array_join("ids", ",").alias("ids"))


def gate_drift(baseline: DataFrame, corpus: DataFrame, pattern: str) -> DataFrame:
    """(item, change): what a matcher accepts now against its baseline (item, accepted)."""
    now = corpus.select("item").distinct().withColumn("now", F.col("item").rlike(pattern))
    met = now.join(baseline.select("item", "accepted"), "item", "left")
    change = F.when(F.col("accepted").isNull(), "new").when(F.col("now") & ~F.col("accepted"), "gained").when(~F.col("now") & F.col("accepted"), "lost").otherwise("same")
    return met.select("item", change.alias("change"))


def unrecognized(extracted: DataFrame, returned: DataFrame) -> DataFrame:
    """Extracted citations (doc_id, cite) that the lookup did not return, compared without case and extra blanks."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    return extracted.withColumn("key", key("cite")).join(returned.select("doc_id", key("cite").alias("key")).distinct(), ["doc_id", "key"], "left_anti").select("doc_id", "cite")


def restate(manifest: DataFrame) -> DataFrame:
    """One (id, value) for each value of a manifest (field, items array): field alone, or field and index."""
    each = manifest.select("field", F.size("items").alias("n"), F.posexplode("items").alias("i", "value"))
    return each.select(F.when(F.col("n") == 1, F.col("field")).otherwise(F.concat_ws("#", "field", "i")).alias("id"), "value")


def restatement_check(sealed: DataFrame, restated: DataFrame, tiers: DataFrame, strict: bool = True) -> DataFrame:
    """(id, outcome, severity) of restated values (id, value) against the sealed: faithful, contained, divergent, unanswered."""
    s, r = sealed.select("id", F.trim("value").alias("want")), restated.select("id", F.trim("value").alias("got"))
    met = s.join(r, "id", "left").join(tiers.select("id", "tier"), "id", "left")
    inside = F.contains(F.col("got"), F.col("want"))
    outcome = F.when(F.col("got").isNull() | (F.col("got") == ""), "unanswered").when(F.col("got") == F.col("want"), "faithful").when(inside & F.lit(not strict), "contained").otherwise("divergent")
    return met.select("id", outcome.alias("outcome"), F.when(outcome == "divergent", F.coalesce("tier", F.lit("notable"))).alias("severity"))
