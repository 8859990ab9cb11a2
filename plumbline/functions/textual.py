"""Text predicates and measures as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Published shapes of credentials, by name.
SECRETS = {
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "aws_temporary_key": r"\bASIA[0-9A-Z]{16}\b",
    "stripe_secret": r"\bsk_live_[0-9a-zA-Z]{24,}\b",
    "stripe_restricted": r"\brk_live_[0-9a-zA-Z]{24,}\b",
    "stripe_webhook": r"\bwhsec_[0-9a-zA-Z]{24,}\b",
    "openai_project": r"\bsk-proj-[A-Za-z0-9_-]{20,}\b",
    "openai_service": r"\bsk-svcacct-[A-Za-z0-9_-]{20,}\b",
    "openai_key": r"\bsk-[A-Za-z0-9]{20,}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "github_fine_grained": r"\bgithub_pat_[A-Za-z0-9_]{22,}\b",
}


@F.pandas_udf(T.StringType())
def _nfkc_folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def folded(text: Column) -> Column:
    """NFKC and case-folded; plain ASCII, where both only lower-case, stays in the JVM."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), _nfkc_folded(text)).otherwise(F.lower(text))


def normalized(text: Column) -> Column:
    """Words after NFKC and case folding, one space between them."""
    return F.array_join(F.regexp_extract_all(folded(text), F.lit("([\\p{L}\\p{N}_]+)"), 1), " ")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row; an expression inside a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def char_grams(text: Column, size: int = 4) -> Column:
    """Distinct character grams; the whole text where it is no longer than one."""
    runs = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - size), lambda i: F.concat(*[F.get(c, i + k) for k in range(size)]))
    many = F.array_distinct(bound(F.split(text, ""), runs))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) <= size, F.array(text)).otherwise(many)


def word_bigrams(text: Column) -> Column:
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return bound(F.split(text, " "), lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs(w))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    of = lambda x, y: F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))))
    return bound(a, lambda x: bound(b, lambda y: of(x, y)))


def overlap(x: Column, y: Column) -> Column:
    """Of normalized texts: 1 only if equal, else the smaller of both Jaccard values, 0.9995 at most; 0 if one is empty."""
    least = F.least(jaccard(char_grams(x), char_grams(y)), jaccard(word_bigrams(x), word_bigrams(y)), F.lit(0.9995))
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(least)


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, 1 at least; 0 for an empty or null text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def head_and_tail(rows: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """The first half of `cap` rows (rounded up) and the last of each key."""
    by = Window.partitionBy(key)
    head = -(-cap // 2)
    numbered = rows.withColumn("_rn", F.row_number().over(by.orderBy(order))).withColumn("_n", F.count("*").over(by))
    return numbered.where((F.col("_rn") <= head) | (F.col("_rn") > F.col("_n") - (cap - head))).drop("_rn", "_n")


def entropy(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bits): Shannon entropy in bits a character; 0 for an empty text.

    Characters are sorted and their runs counted within the key's row, so that
    they are neither shuffled nor held in a table over all keys.
    """
    start = F.struct(F.lit(None).cast("struct<n:int,c:string>").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("sum"))

    def ended(state: Column) -> Column:
        share = state["run"] / F.greatest(state["last"]["n"], F.lit(1))
        return F.when(state["run"] > 0, state["sum"] + share * F.log2(share)).otherwise(state["sum"])

    def add(state: Column, x: Column) -> Column:
        same = state["last"].eqNullSafe(x)
        return F.struct(x.alias("last"), F.when(same, state["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"), F.when(same, state["sum"]).otherwise(ended(state)).alias("sum"))

    each = lambda t: F.transform(F.coalesce(F.split(t, ""), F.array(F.lit(None).cast("string"))), lambda c: F.struct(F.length(t).alias("n"), c.alias("c")))
    # a key's texts are dealt to it before they are gathered: what a task holds is its share of the keys
    texts = rows.select(key, F.struct(F.col(text).alias("t")).alias("_t")).repartition(key).groupBy(key).agg(F.collect_list("_t").alias("_t"))
    bits = F.aggregate(F.array_sort(F.flatten(F.transform("_t", lambda t: each(t["t"])))), start, add, lambda state: -ended(state))
    return texts.select(key, F.round(bits + 0.0, 6).alias("bits"))


def url_name(url: Column) -> Column:
    """scheme://host:port/path of a URL, without user, query and fragment."""
    part = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)", i)
    return F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3)))
