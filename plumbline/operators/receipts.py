"""Receipts, packs and checkpoints: each facet is checked by itself, and a roll-up takes the worst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.canon import GENESIS, LINK
from plumbline.functions.verdicts import worst_of

#: Verdicts of a receipt from the worst on; recipe of a body's digest.
ORDER = ["tampered", "mismatch", "could_not_look", "good"]
RECIPE = "sha256:raw-bytes:v1:"


def body_digest(body: Column) -> Column:
    return F.concat(F.lit(RECIPE), F.sha2(body.cast("binary"), 256))


def produce(rows: DataFrame) -> DataFrame:
    """Receipts of rows (id, body, proves array, does_not_prove array): digest, and whether one may be issued.

    What a receipt proves and what it doesn't must both be stated.
    """
    stated = (F.size(F.coalesce("proves", F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce("does_not_prove", F.array().cast("array<string>"))) > 0)
    return rows.select("id", "body", body_digest(F.col("body")).alias("digest"), F.when(stated, "issued").otherwise("refused").alias("state"))


def verify(receipts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Facets and verdict of receipts (id, body, digest, chain, signed) against ledger rows (digest, chain).

    body: the digest reproduces; row: the ledger has this digest under this
    chain (false: under another one only; null: not at all); signature: names
    this digest (null: none).
    """
    rows = ledger.groupBy("digest").agg(F.collect_set("chain").alias("chains")) if "chains" not in ledger.columns else ledger
    met = receipts.join(rows, "digest", "left")
    body = body_digest(F.col("body")) == F.col("digest")
    row = F.when(F.col("chains").isNotNull(), F.array_contains("chains", F.col("chain")))
    signature = F.when(F.col("signed").isNotNull(), F.col("signed") == F.col("digest"))
    word = F.when(~body, "tampered").when(~F.coalesce(row, F.lit(True)) | ~F.coalesce(signature, F.lit(True)), "mismatch").when(row.isNull(), "could_not_look").otherwise("good")
    return met.select("id", body.alias("body_ok"), row.alias("row_ok"), signature.alias("signature_ok"), word.alias("verdict"))


def batch(verified: DataFrame, group: str) -> DataFrame:
    """(group, n, counts by verdict, worst) of receipts."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return verified.groupBy(group).agg(F.count("*").alias("n"), *[n(v) for v in ORDER], worst_of(F.col("verdict"), ORDER).alias("worst"))


def sibling(receipts: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Each receipt's (path, ledger_name) ledger in its own folder; null where there is none."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    known = ledgers.select(folder.alias("folder"), name.alias("ledger_name"), F.col("path").alias("ledger_path"))
    return receipts.withColumn("folder", folder).join(known, ["folder", "ledger_name"], "left").select("path", "ledger_path")


def window_check(window: DataFrame, source: DataFrame) -> DataFrame:
    """(line, finding) of pack rows (line, raw) that aren't their source's bytes: missing_in_source or differs."""
    met = window.join(source.select("line", F.col("raw").alias("source")), "line", "left")
    finding = F.when(F.col("source").isNull(), "missing_in_source").when(F.col("source") != F.col("raw"), "differs")
    return met.select("line", finding.alias("finding")).where("finding is not null")


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, finding) over a manifest (path, sha256) and files (path, content): good, differs, missing or unlisted."""
    met = manifest.join(files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("now"), F.lit(True).alias("there")), "path", "full")
    return met.select("path", F.when(F.col("there").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("now") == F.col("sha256"), "good").otherwise("differs").alias("finding"))


def approval_gate(proposed: DataFrame, decided: DataFrame, executed: DataFrame) -> DataFrame:
    """(digest, verdict): the action that ran is the one approved, and a denied one didn't run.

    decided cites the proposal's chain, executed the decision's; one that cites
    another chain answers for nothing.
    """
    p = proposed.select("digest", F.col("chain").alias("p_chain"))
    d = decided.select("digest", F.col("cites").alias("p_chain"), "decision", F.col("chain").alias("d_chain"))
    e = executed.select("digest", F.col("cites").alias("d_chain"), "ran_digest", F.lit(True).alias("closed"))
    met = p.join(d, ["digest", "p_chain"], "left").join(e, ["digest", "d_chain"], "left")
    ran = F.col("ran_digest").isNotNull()
    word = (
        F.when(F.col("decision").isNull(), "undecided")
        .when(F.col("closed").isNull(), "not_closed")
        .when((F.col("decision") == "approved") & ran, F.when(F.col("ran_digest") == F.col("digest"), "as_approved").otherwise("ran_otherwise"))
        .when(F.col("decision") == "approved", "approved_not_run")
        .when(ran, "denied_but_ran")
        .otherwise("as_denied")
    )
    return met.select("digest", word.alias("verdict"))


def checkpoint(due: DataFrame, attempts: DataFrame, stored: DataFrame, refusals: DataFrame) -> DataFrame:
    """(id, outcome) of due checkpoints, from evidence that is kept apart; what is missing is never read as a refusal.

    A stored receipt without an attempt contradicts itself and is an error.
    """
    met = due.select("id").join(attempts.select("id", F.lit(True).alias("tried")).distinct(), "id", "left").join(stored.select("id", "scored"), "id", "left").join(refusals.select("id", F.lit(True).alias("refused")).distinct(), "id", "left")
    word = (
        F.when(F.col("refused"), "refused_explicitly")
        .when(F.col("tried").isNull() & F.col("scored").isNotNull(), "error_contradictory_evidence")
        .when(F.col("tried").isNull(), "due_not_attempted")
        .when(F.col("scored").isNull(), "attempted_no_receipt")
        .when(F.col("scored") == "faithful", "receipt_received_faithful")
        .when(F.col("scored") == "contained", "receipt_received_contained")
        .otherwise("receipt_received_divergent")
    )
    return met.select("id", word.alias("outcome"))


def delivery(rows: DataFrame) -> DataFrame:
    """(id, outcome, unresolved) of deliveries (id, delivered_at, deadline, refused, attributed, anchored, contested, verifiable, witness_live).

    The five unresolved outcomes say that evidence is missing, not that someone
    failed.
    """
    c = F.col
    word = (
        F.when(~c("witness_live"), "witness_liveness_lost")
        .when(c("contested"), "witness_authority_unresolved")
        .when(c("refused") & ~c("attributed"), "refusal_unattributed")
        .when(c("refused") & ~c("anchored"), "refusal_unanchored")
        .when(~c("verifiable"), "receipt_unverifiable")
        .when(c("refused") & c("delivered_at").isNotNull(), "delivered_refused")
        .when(c("delivered_at") > c("deadline"), "delivered_overdue")
    )
    return rows.select("id", word.alias("outcome"), F.coalesce(word.isin("witness_liveness_lost", "witness_authority_unresolved", "refusal_unattributed", "refusal_unanchored", "receipt_unverifiable"), F.lit(False)).alias("unresolved"))


def binds(rows: DataFrame, last_live: DataFrame) -> DataFrame:
    """(ledger_id, line, bound): rows up to the last pin of a witness that is gone stay bound, later ones don't."""
    return rows.join(last_live, "ledger_id").select("ledger_id", "line", (F.col("line") <= F.col("rows")).alias("bound"))


def pin_file_check(pins: DataFrame) -> DataFrame:
    """(line, finding) of pins (line, body, prev, self) of one file: each names the pin before it and digests itself.

    The file is one chain, but every pin is checked by its own row and the one
    before; the lines' order is all that has to be sorted.
    """
    before = F.lag("self", 1, GENESIS).over(Window.partitionBy("file").orderBy("line"))
    want = F.substring(F.sha2(F.concat("prev", "body"), 256), 1, LINK)
    finding = F.when(F.col("prev") != F.col("before"), "prev").when(F.col("self") != want, "self")
    return pins.withColumn("before", before).select("file", "line", finding.alias("finding")).where("finding is not null")


def route_pins(pins: DataFrame, tapes: DataFrame, most: int = 2) -> DataFrame:
    """(pin, tape): a pin (pin, side, ns) goes to the tapes (tape, side, ns) of its side, else of its namespace, else to all.

    A comparison has two tapes, an agent's and a tool's; more than `most` are
    refused (ValueError), as a pin without side and namespace names none of them.
    """
    names = [r["tape"] for r in tapes.select("tape").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"a comparison has at most {most} tapes")
    by_side = pins.join(tapes.select("side", "tape"), "side").select("pin", "tape")
    rest = pins.join(by_side.select("pin").distinct(), "pin", "left_anti")
    by_ns = rest.join(tapes.select("ns", "tape"), "ns").select("pin", "tape")
    lost = rest.join(by_ns.select("pin").distinct(), "pin", "left_anti").select("pin")
    every = lost.select("pin", F.explode(F.array(*map(F.lit, names)).cast(f"array<{tapes.schema['tape'].dataType.simpleString()}>")).alias("tape"))
    return by_side.unionAll(by_ns).unionAll(every)


def export_record(rows: DataFrame) -> DataFrame:
    """(id, record): rows as JSON objects that leave out what a row doesn't have."""
    rest = [c for c in rows.columns if c != "id"]
    return rows.select("id", F.to_json(F.struct(*rest), {"ignoreNullFields": "true"}).alias("record"))
