"""Rows of readings ledgers: criteria and readings as they are built, and which of a batch may be appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.raters import READINGS, canonical_reader
from plumbline.operators.rows import read_rows
from plumbline.session import settled
from plumbline.sources import appending

READING, CRITERION = "reading/1", "criterion/1"
HEX64 = r"\A[0-9a-f]{64}\z"
BATCH = "ledger_id string, n long, evt string, sha string, supersedes string, raw string, problem string"


def _empty(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+", "") == "", F.lit(True))


def _no_hex(digest: Column) -> Column:
    return ~F.coalesce(digest.rlike(HEX64), F.lit(False))


def frozen(text: Column) -> Column:
    """A criterion's text as it is frozen: line ends as LF, without white space around it."""
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(lines, r"(?U)^\s+|\s+$", "")


def build_criteria(rows: DataFrame, ts: str) -> DataFrame:
    """Batch rows (BATCH) of criteria (ledger_id, n, text, supersedes: the digest that it revises, or null)."""
    text = frozen(F.col("text"))
    sha = F.sha2(text, 256)
    problem = F.when(_empty(F.col("text")), "criterion text is empty").when(F.col("supersedes").isNotNull() & _no_hex(F.col("supersedes")), "supersedes is no sha256")
    common = [F.lit("criterion").alias("evt"), F.lit(CRITERION).alias("format"), sha.alias("criterion_sha256"), text.alias("text")]
    raw = F.to_json(F.struct(*common, F.col("supersedes"), F.lit(ts).alias("ts")), {"ignoreNullFields": "true"})
    return rows.select("ledger_id", F.col("n").cast("long").alias("n"), F.lit("criterion").alias("evt"), sha.alias("sha"), "supersedes", raw.alias("raw"), problem.alias("problem"))


def build_readings(rows: DataFrame, ts: str, keep_text: bool = False) -> DataFrame:
    """Batch rows (BATCH) of readings.

    rows: ledger_id, n, claim_id, claim_text, claim_sha256 (one of both, or both
    if they agree), criterion_sha256, reader struct(id, provider, model,
    endpoint_host), reading, near_match_id, rationale, prompt_sha256. A
    rationale's digest is kept, its text only with `keep_text`.
    """
    c = F.col
    own = F.sha2("claim_text", 256)
    claim = F.coalesce(own, "claim_sha256")
    problem = (
        F.when(~F.coalesce(c("reading").isin(list(READINGS)), F.lit(False)), "unknown reading")
        .when(_empty(c("claim_id")), "claim_id is empty")
        .when(claim.isNull(), "no claim")
        .when((c("claim_sha256") != own) & own.isNotNull(), "claim_sha256 is not the claim_text's")
        .when(_no_hex(claim) | _no_hex(c("criterion_sha256")) | (c("prompt_sha256").isNotNull() & _no_hex(c("prompt_sha256"))), "no sha256")
        .when(_empty(c("reader.id")) | _empty(c("reader.provider")), "reader needs an id and a provider")
        .when(c("near_match_id") == "", "near_match_id is empty")
    )
    reader = F.struct(canonical_reader(c("reader.id")).alias("id"), *[c(f"reader.{k}").alias(k) for k in ("provider", "model", "endpoint_host")])
    first = [F.lit("reading").alias("evt"), F.lit(READING).alias("format"), "claim_id", claim.alias("claim_sha256"), "criterion_sha256", reader.alias("reader"), "reading"]
    last = [F.sha2("rationale", 256).alias("rationale_sha256"), c("prompt_sha256"), F.lit(ts).alias("ts")]
    near, said = c("near_match_id"), c("rationale").alias("rationale")
    as_json = lambda *more: F.to_json(F.struct(*first, *more, *last), {"ignoreNullFields": "false"})
    text = (said,) if keep_text else ()
    raw = F.when(near.isNull() & (c("rationale").isNull() | F.lit(not keep_text)), as_json()).when(near.isNull(), as_json(*text)).when(c("rationale").isNull(), as_json(near)).otherwise(as_json(near, *text))
    return rows.select("ledger_id", c("n").cast("long").alias("n"), F.lit("reading").alias("evt"), c("criterion_sha256").alias("sha"), F.lit(None).cast("string").alias("supersedes"), raw.alias("raw"), problem.alias("problem"))


def guarded(batch: DataFrame, known: DataFrame) -> DataFrame:
    """The batch (BATCH) with a problem for every row that cites what isn't frozen before it.

    known: (ledger_id, sha) of the criteria that each ledger has. A reading
    needs its criterion, a criterion the one that it revises: in the ledger or
    on an earlier row (n) of the batch that is itself taken. Rounds settle one
    step of a chain of revisions each. Rows that have a problem freeze nothing;
    rows without ledger or n are refused.
    """
    rows = settled(batch.withColumn("problem", F.coalesce("problem", F.when(F.col("ledger_id").isNull() | F.col("n").isNull(), "no place"))))
    criteria = rows.where("evt = 'criterion' and problem is null").select("ledger_id", "n", "sha", "supersedes")
    taken = settled(known.select("ledger_id", "sha", F.lit(None).cast("long").alias("n")).unionAll(criteria.where("supersedes is null").select("ledger_id", "sha", "n")).distinct())
    waiting = criteria.where("supersedes is not null")

    def before(taken: DataFrame) -> DataFrame:
        """(ledger_id, sha, since): from which row on a criterion counts; what the ledger has counts for all."""
        return taken.groupBy("ledger_id", "sha").agg(F.min(F.coalesce("n", F.lit(-(1 << 62)))).alias("since"))

    while True:
        since = before(taken).withColumnRenamed("sha", "supersedes")
        able = waiting.join(since, ["ledger_id", "supersedes"]).where(F.col("since") < F.col("n")).select("ledger_id", "sha", "n")
        new = able.join(taken, ["ledger_id", "sha", "n"], "left_anti")
        if new.isEmpty():
            break
        taken = settled(taken.unionAll(new).distinct())
    wanted = F.when(F.col("evt") == "criterion", F.col("supersedes")).otherwise(F.col("sha"))
    since = before(taken).withColumnRenamed("sha", "wanted")
    met = rows.withColumn("wanted", wanted).join(since, ["ledger_id", "wanted"], "left")
    unknown = F.col("wanted").isNotNull() & ~F.coalesce(F.col("since") < F.col("n"), F.lit(False))
    message = F.when(F.col("evt") == "criterion", "supersedes no earlier criterion").otherwise("criterion is not frozen earlier")
    return met.withColumn("problem", F.coalesce("problem", F.when(unknown, message))).select(*[k.split()[0] for k in BATCH.split(", ")])


def frozen_in(spark: SparkSession, folder: str) -> DataFrame:
    """(ledger_id, sha) of the criteria in an append store."""
    rows = read_rows(appending.read(spark, folder)).where("state = 'row'")
    part = lambda k: F.get_json_object("body", f"$.{k}")
    return rows.where(part("evt") == "criterion").select("ledger_id", part("criterion_sha256").alias("sha")).distinct()


def append(spark: SparkSession, folder: str, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Appends a batch's good rows to the store, all together; (what the ledgers are now, the refused rows)."""
    checked = settled(guarded(batch, frozen_in(spark, folder)))
    return appending.append(spark, folder, checked.where("problem is null").select("ledger_id", "n", "raw"), stamp=False), checked.where("problem is not null")
