"""Citations of long texts looked up in chunks, and again by paragraph where a service would not answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.textual import bound
from plumbline.operators.scoring import chunks
from plumbline.session import settled

#: Characters and citations of one request, and rounds of retries.
MOST_TEXT, MOST_CITES, ROUNDS = 64_000, 250, 3
LIMITED = "not_checked_rate_limit"


def spans(text: Column, pattern: str) -> Column:
    """array<struct(cite, start, stop)> of a pattern's matches, in order; what lies between matches gives their places."""
    between, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<cite:string,start:int,stop:int>>").alias("done"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["b"])
        stop = begin + F.length(pair["c"])
        return F.struct(stop.alias("at"), F.concat(state["done"], F.array(F.struct(pair["c"].alias("cite"), begin.alias("start"), stop.alias("stop")))).alias("done"))

    pairs = bound(between, lambda b: F.transform(found, lambda c, i: F.struct(F.get(b, i).alias("b"), c.alias("c"))))
    return F.aggregate(pairs, start, add)["done"]


def look_up(texts: DataFrame, answers: DataFrame, pattern: str, most: int = MOST_TEXT, per_request: int = MOST_CITES, rounds: int = ROUNDS) -> DataFrame:
    """(key, start, stop, cite, status, attempts) of every citation in texts (key, text; keys are unique), in order of key and start.

    Texts go out in chunks of whole paragraphs of `most` characters, spans
    count from the text's start. `answers` (cite, attempt, status) is what the
    service says of a citation the first, second, ... time; of what it doesn't
    know it says `not_found`, and of citations beyond `per_request` in one
    request nothing: they are limited. For up to `rounds` rounds the paragraphs
    that hold limited citations are asked again, whole (one that is longer than
    a request in pieces), and their new answers replace the old. What is limited
    after that stays so. Null texts have no citations.
    """
    rows = settled(texts.select("key", "text"))
    paragraphs = chunks(rows, 1).select("key", F.col("chunk").alias("paragraph"), F.col("offset").alias("begin"), (F.col("offset") + F.col("size")).alias("finish"))
    wide = chunks(rows, most).select("key", "chunk", F.col("offset").alias("from"), (F.col("offset") + F.col("size")).alias("to"))
    found = rows.select("key", F.explode(spans(F.col("text"), pattern)).alias("c")).select("key", "c.*")
    # starts of paragraphs, of chunks and of citations are gone through in order, so no text's are paired with each other
    marks = paragraphs.select("key", F.col("begin").alias("at"), F.lit(0).alias("cited"), F.struct("paragraph", "begin", "finish").alias("p"))
    marks = marks.unionByName(wide.select("key", F.col("from").alias("at"), F.lit(0).alias("cited"), F.struct("chunk", "to").alias("w")), allowMissingColumns=True)
    marks = marks.unionByName(found.select("key", F.col("start").alias("at"), F.lit(1).alias("cited"), "start", "stop", "cite"), allowMissingColumns=True)
    so_far = Window.partitionBy("key").orderBy("at", "cited").rowsBetween(Window.unboundedPreceding, 0)
    met = marks.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in "pw"}).where("cited = 1")
    placed = met.select("key", "start", "stop", "cite", "p.*", "w.*").where("start < finish and start < to")
    placed = settled(placed.select("key", "start", "stop", "cite", "paragraph", F.floor((F.col("start") - F.col("begin")) / most).alias("piece"), "chunk"))

    def asked(cites: DataFrame, request: list[str], attempt: int) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*request).orderBy("start"))
        said = answers.where(F.col("attempt") == attempt).select("cite", F.col("status").alias("said"))
        met = cites.withColumn("nth", nth).join(said, "cite", "left")
        status = F.when(F.col("nth") > per_request, LIMITED).otherwise(F.coalesce("said", F.lit("not_found")))
        return met.select("key", "start", "stop", "cite", "paragraph", "piece", status.alias("status"), F.lit(attempt).alias("attempts"))

    checks = settled(asked(placed, ["key", "chunk"], 1))
    for attempt in range(2, rounds + 2):
        hot = checks.where(F.col("status") == LIMITED).select("key", "paragraph").distinct()
        if hot.isEmpty():
            break
        again = asked(checks.drop("status", "attempts").join(hot, ["key", "paragraph"], "left_semi"), ["key", "paragraph", "piece"], attempt)
        checks = settled(checks.join(hot, ["key", "paragraph"], "left_anti").select(again.columns).unionAll(again))
    return checks.select("key", "start", "stop", "cite", "status", "attempts").orderBy("key", "start")
