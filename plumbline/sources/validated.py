"""Files that are read whole or not at all: every bad row is found before anything goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.scoring import KINDS

SHOWN = 20


class BadRows(ValueError):
    """Rows that make a file unfit; `problems` (file, line, problem) has all of them."""

    def __init__(self, problems: DataFrame, shown: list, count: int):
        self.problems = problems
        super().__init__(f"{count} bad rows: " + "; ".join(f"{r['ledger_id']}:{r['line']} {r['problem']}" for r in shown))


def whole(checked: DataFrame) -> DataFrame:
    """The rows of `checked`, without `problem`, if none has one and there are any; else BadRows or ValueError."""
    bad = checked.where("problem is not null").select("ledger_id", "line", "problem")
    shown = bad.orderBy("ledger_id", "line").limit(SHOWN).collect()
    if shown:
        raise BadRows(bad, shown, bad.count())
    if checked.isEmpty():
        raise ValueError("there are no rows")
    return checked.drop("problem")


def _kind(value: Column, path: str) -> Column:
    """Type of a JSON value at a path: STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, OBJECT<..>, ARRAY<..>, VOID, or null where there is none."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _text(value: Column, path: str) -> Column:
    return F.when(_kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def _objects(lines: DataFrame) -> tuple[DataFrame, Column]:
    """Lines that aren't blank with `v`, and what is wrong with them as JSON objects."""
    rows = lines.where(~_blank(F.col("raw"))).withColumn("v", F.try_parse_json("raw"))
    shape = F.schema_of_variant("v")
    return rows, F.when(F.col("v").isNull(), "invalid JSON").when(~shape.startswith("OBJECT"), "not a JSON object")


def _once(rows: DataFrame, key: str, problem: str) -> DataFrame:
    """A row whose key an earlier line has gets the problem, if it has none yet."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("ledger_id", "line"))
    again = F.col(key).isNotNull() & (place > 1)
    return rows.withColumn("problem", F.coalesce("problem", F.when(again, problem)))


def claims(lines: DataFrame) -> DataFrame:
    """(ledger_id, line, claim_id, claim, near_match_id, problem) of lines (ledger_id, line, raw) of JSON objects.

    claim_id is text that isn't blank, once in all files; claim is text;
    near_match_id is absent, null or text that isn't empty. Blank lines are
    none. Give the result to `whole`.
    """
    rows, problem = _objects(lines)
    claim_id, claim, near = (_text(F.col("v"), f"$.{k}") for k in ("claim_id", "claim", "near_match_id"))
    near_kind = F.coalesce(_kind(F.col("v"), "$.near_match_id"), F.lit("VOID"))
    problem = problem.when(_blank(claim_id), "claim_id must be a non-empty string").when(claim.isNull(), "claim must be a string").when((near_kind != "VOID") & (F.coalesce(near, F.lit("")) == ""), "near_match_id must be a non-empty string")
    found = rows.select("ledger_id", "line", claim_id.alias("claim_id"), claim.alias("claim"), near.alias("near_match_id"), problem.alias("problem"))
    return _once(found, "claim_id", "claim_id appears twice")


def probes(lines: DataFrame) -> DataFrame:
    """(ledger_id, line, id, prompt, kind, answer, tolerance, answerable, raw, problem) of lines of probe files.

    A probe has an id, once in all files, a prompt, and a scoring object whose
    type is known and has the answer its type asks for: text for an exact match
    and an answerable calibration, a number (or text that is one) for a numeric
    one, a boolean `answerable` for a calibration.
    """
    rows, problem = _objects(lines)
    v, answer_kind = F.col("v"), F.coalesce(_kind(F.col("v"), "$.scoring.answer"), F.lit("none"))
    part = lambda p: F.try_variant_get(v, p, "string")
    kind, answer = _text(v, "$.scoring.type"), part("$.scoring.answer")
    answerable = F.when(_kind(v, "$.scoring.answerable") == "BOOLEAN", F.try_variant_get(v, "$.scoring.answerable", "boolean"))
    for key in ("id", "prompt", "scoring"):
        problem = problem.when(_kind(v, f"$.{key}").isNull(), f"missing {key}")

    def unfit(path: str) -> Column:
        found = _kind(v, path)
        return found.isNotNull() & ((found == "BOOLEAN") | part(path).try_cast("double").isNull())

    problem = (
        problem.when(~_kind(v, "$.scoring").startswith("OBJECT") | kind.isNull(), "scoring must be an object with a type")
        .when(~kind.isin(list(KINDS)), "unknown scoring type")
        .when((kind == "calibration") & answerable.isNull(), "calibration needs a boolean answerable")
        .when((kind == "calibration") & answerable & (answer_kind != "STRING"), "an answerable calibration needs a string answer")
        .when((kind == "exact_match") & (answer_kind != "STRING"), "exact_match needs a string answer")
        .when((kind == "numeric_tolerance") & (answer_kind == "none"), "numeric_tolerance needs an answer")
        .when((kind == "numeric_tolerance") & (unfit("$.scoring.answer") | unfit("$.scoring.tolerance")), "numeric_tolerance needs numbers")
    )
    found = rows.select(
        "ledger_id",
        "line",
        part("$.id").alias("id"),
        part("$.prompt").alias("prompt"),
        kind.alias("kind"),
        answer.alias("answer"),
        part("$.scoring.tolerance").try_cast("double").alias("tolerance"),
        answerable.alias("answerable"),
        "raw",
        problem.alias("problem"),
    )
    return _once(found, "id", "id appears twice")


#: Columns that a roster has to name, and those it may.
REQUIRED, OPTIONAL = ("trainee", "ballot_path"), ("scenario", "grader", "timestamp")


def slug(name: Column) -> Column:
    """Name of the file that a trainee's receipt is written to."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(plain == "", "trainee").otherwise(plain)


def roster(lines: DataFrame, ballots: DataFrame, scenario: str = "", grader: str = "", timestamp: str | None = None) -> DataFrame:
    """(ledger_id, line, trainee, slug, ballot_path, ballot, scenario, grader, timestamp, problem) of a CSV roster's lines.

    `ballots` (path, text) are the files that it may name, by their path from
    the roster's folder. The first line names the columns, in any order; a byte
    order mark before it is none of a name. Every trainee needs a ballot that
    is there and reads as JSON, a scenario (its own or the default), and a slug
    that no earlier row has. Lines without any value are spacing.
    """
    head = lines.where("line = 1").select("raw").limit(1).collect()
    names = [n.strip().strip('"') for n in head[0]["raw"].removeprefix("﻿").rstrip("\r").split(",")] if head else []
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"the header must name {', '.join(missing)} (it has: {', '.join(names) or 'nothing'})")
    fields = F.from_csv(F.regexp_replace("raw", "\r$", ""), F.lit(", ".join(f"c{i} string" for i in range(len(names)))))
    rows = lines.where("line > 1").withColumn("f", fields)
    value = lambda c: F.trim(F.coalesce(F.col(f"f.c{names.index(c)}"), F.lit(""))) if c in names else F.lit("")
    either = lambda c, default: F.when(value(c) != "", value(c)).otherwise(F.lit(default))
    filled = rows.where(F.concat(*[F.trim(F.coalesce(F.col(f"f.c{i}"), F.lit(""))) for i in range(len(names))]) != "")
    picked = filled.select("ledger_id", "line", value("trainee").alias("trainee"), value("ballot_path").alias("ballot_path"), either("scenario", scenario).alias("scenario"), either("grader", grader).alias("grader"), either("timestamp", timestamp).alias("timestamp"))
    known = ballots.groupBy(F.col("path").alias("ballot_path")).agg(F.first("text").alias("ballot"), F.lit(True).alias("there"))
    met = picked.join(known, "ballot_path", "left").withColumn("slug", F.when(F.col("trainee") != "", slug(F.col("trainee"))))
    problem = (
        F.when(F.col("trainee") == "", "trainee is empty")
        .when(F.col("ballot_path") == "", "ballot_path is empty")
        .when(F.col("there").isNull(), "ballot file not found")
        .when(F.try_parse_json("ballot").isNull(), "ballot is not readable JSON")
        .when(F.col("scenario") == "", "no scenario")
    )
    found = met.select("ledger_id", "line", "trainee", "slug", "ballot_path", "ballot", "scenario", "grader", "timestamp", problem.alias("problem"))
    return _once(found, "slug", "slug collides with an earlier row")


def journal(lines: DataFrame) -> DataFrame:
    """(ledger_id, line, t, verb, word, code, target, reason_word) of an activity journal's lines; others than objects with a text `verb` are skipped."""
    rows = lines.withColumn("v", F.try_parse_json(F.trim("raw"))).where(F.schema_of_variant("v").startswith("OBJECT"))
    text = lambda k: _text(F.col("v"), f"$.{k}").alias(k)
    code = F.when(_kind(F.col("v"), "$.exit") == "BIGINT", F.try_variant_get(F.col("v"), "$.exit", "long"))
    return rows.select("ledger_id", "line", text("t"), text("verb"), text("word"), code.alias("code"), text("target"), text("reason_word")).where("verb is not null")
