"""Receipts as JSON documents: issued into an append store, and checked whole: body, keys, ledger row at its place, witness, signature."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.canon import GENESIS, digest, link, parse
from plumbline.operators import chain
from plumbline.operators.rows import read_rows
from plumbline.session import settled
from plumbline.sources import appending

#: The fields that a body digest covers.
BODY = ("receipt_version", "kind", "issued_at", "subject", "checks", "scope", "extra")
VERSION = "receipt/1"
READ = "state string, twice boolean, body boolean, digest string, rows long, chain string, witness string, signature string"


def _witness(receipt: dict) -> str:
    """absent, claimed, or inconsistent: what its witness block says of itself, of the ledger block and of its pin."""
    block = receipt.get("witness")
    if block is None:
        return "absent"
    if not isinstance(block, dict):
        return "inconsistent"
    if block.get("status") == "skipped" and not {"kind", "pin", "rows", "chain"} & block.keys():
        return "absent"
    ledger = receipt["ledger"] if isinstance(receipt.get("ledger"), dict) else {}
    pin = block.get("pin")
    if pin is not None and not isinstance(pin, dict):
        return "inconsistent"
    pin = pin or {}
    fine = all(block[k] == ledger[k] for k in ("rows", "chain", "namespace") if k in block and k in ledger)
    fine = fine and all(pin[k] == block[k] for k in ("rows", "chain", "namespace") if k in pin and k in block)
    if fine and {"self", "prev"} <= pin.keys():
        fine = link("", pin, ("prev", "self")) == pin["self"]
    return "claimed" if fine else "inconsistent"


def _signature(receipt: dict) -> str:
    """absent, could_not_look (it names this body, but its value can't be checked), or mismatch."""
    block = receipt.get("attestation_signature")
    if block is None:
        return "absent"
    if not isinstance(block, dict) or block.get("signed_over", "body_digest") != "body_digest":
        return "mismatch"
    return "could_not_look" if block.get("body_digest") == receipt.get("body_digest") else "mismatch"


def _one(raw: str | None) -> dict:
    ok, receipt = parse(raw) if raw is not None else (False, None)
    if not ok or not isinstance(receipt, dict):
        return {"state": "no_object" if ok else "unreadable"}
    try:
        want = digest({k: receipt.get(k) for k in BODY})
    except (ValueError, RecursionError):
        return {"state": "no_digest"}
    said, ledger = receipt.get("body_digest"), receipt.get("ledger")
    ledger = ledger if isinstance(ledger, dict) else {}
    text = lambda v: v if isinstance(v, str) else None
    rows = ledger.get("rows")
    rows = rows if isinstance(rows, int) and not isinstance(rows, bool) and abs(rows) < 1 << 62 else None
    return {"state": "read", "twice": not parse(raw, unique_keys=True)[0], "body": said == want, "digest": text(said), "rows": rows, "chain": text(ledger.get("chain")), "witness": _witness(receipt), "signature": _signature(receipt)}


def read(receipts: DataFrame) -> DataFrame:
    """(id, ledger_id, READ) of receipts (id, ledger_id: null if its ledger isn't at hand, raw): all that a document says by itself."""
    kind = pa.struct([("state", pa.string()), ("twice", pa.bool_()), ("body", pa.bool_()), ("digest", pa.string()), ("rows", pa.int64()), ("chain", pa.string()), ("witness", pa.string()), ("signature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([_one(r) for r in batch.column(2).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found.flatten()], names=["id", "ledger_id", *[f.name for f in kind]])

    schema = f"id {receipts.schema['id'].dataType.simpleString()}, ledger_id string, {READ}"
    return receipts.select("id", F.col("ledger_id").cast("string"), F.col("raw").cast("string")).mapInArrow(run, schema)


def placed(rows: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """rows (ledger_id, line, ...) with `n`, their number in the ledger; a ledger of any size is cut into chunks of lines."""
    cut = rows.withColumn("_chunk", F.floor(F.col("line") / chunk))
    sizes = cut.groupBy("ledger_id", "_chunk").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("ledger_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("ledger_id", "_chunk").orderBy("line"))
    return cut.withColumn("_inside", inside).join(sizes.select("ledger_id", "_chunk", before.alias("_before")), ["ledger_id", "_chunk"]).withColumn("n", F.col("_inside") + F.col("_before")).drop("_chunk", "_inside", "_before")


def check(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, body_ok, duplicate_keys, ledger, witness, signature, ok) of receipts (id, ledger_id, raw) against ledger lines (ledger_id, line, raw).

    ledger: not_checked (no ledger_id), missing (no such ledger), chain_broken,
    row_not_found (no row has this digest under this chain), head_mismatch (the
    chain at the stated number of rows is another), or consistent. ok is true
    only if the body reproduces, no key stands twice, the ledger is consistent
    or not checked, the witness block agrees with itself, the ledger block and
    its pin, and a signature names this body; null if the document can't be
    read, its body has no digest, or its ledger is missing. Repeated receipts
    come back as often as they come.
    """
    seen = read(receipts)
    rows = settled(read_rows(lines))
    good = rows.where("state = 'row'")
    verified = chain.verify(good.drop("state")).select("ledger_id", (F.col("breaks") == 0).alias("unbroken"))
    unread = rows.groupBy("ledger_id").agg((F.count_if(F.col("state").isin("unreadable", "no_object")) > 0).alias("unread"))
    known = unread.join(verified, "ledger_id", "left")
    stated = F.get_json_object("body", "$.body_digest")
    there = good.select("ledger_id", stated.alias("digest"), "chain").where("digest is not null and chain is not null").distinct().withColumn("found", F.lit(True))
    at = placed(good).select("ledger_id", F.col("n").alias("rows"), F.coalesce("chain", F.lit(GENESIS)).alias("at"))
    met = seen.join(known, "ledger_id", "left").join(there, ["ledger_id", "digest", "chain"], "left").join(at, ["ledger_id", "rows"], "left")
    head = F.when(F.col("rows") <= 0, GENESIS).otherwise(F.col("at"))
    ledger = (
        F.when(F.col("ledger_id").isNull(), "not_checked")
        .when(F.col("unread").isNull(), "missing")
        .when(F.col("unread") | ~F.coalesce("unbroken", F.lit(True)), "chain_broken")
        .when(F.col("found").isNull(), "row_not_found")
        .when(~F.coalesce(head == F.col("chain"), F.lit(False)), "head_mismatch")
        .otherwise("consistent")
    )
    met = met.withColumn("ledger", F.when(F.col("state") == "read", ledger))
    bad = ~F.col("body") | F.col("twice") | F.col("ledger").isin("chain_broken", "row_not_found", "head_mismatch") | (F.col("witness") == "inconsistent") | (F.col("signature") == "mismatch")
    ok = F.when(F.col("state") != "read", F.lit(None).cast("boolean")).when(bad, False).when(F.col("ledger") == "missing", F.lit(None).cast("boolean")).otherwise(True)
    return met.select("id", F.col("body").alias("body_ok"), F.col("twice").alias("duplicate_keys"), "ledger", "witness", "signature", ok.alias("ok"))


def _stated(part: Column) -> Column:
    return F.coalesce(F.json_array_length(part) > 0, F.lit(False))


def issue(spark: SparkSession, folder: str, bodies: DataFrame, issued_at: str) -> tuple[DataFrame, DataFrame]:
    """Receipts for bodies (id, ledger_id, n, kind, subject, checks, scope, extra: JSON text), each with its row in the store's ledger.

    (id, ledger_id, raw) of what was issued, and (id, problem) of what was
    refused: a scope has to state what a receipt proves and what it doesn't, and
    subject, checks and extra have to be JSON of their kinds. All rows of a call
    are appended together, in order of n; ids are those of single bodies.
    """

    def one(kind: str | None, subject: str | None, checks: str | None, scope: str | None, extra: str | None) -> tuple[str | None, str | None, str | None]:
        parts = [parse(p) if p is not None else (False, None) for p in (subject, checks, scope, extra)]
        kinds = (dict, list, dict, dict)
        if not kind or not all(ok and isinstance(v, k) for (ok, v), k in zip(parts, kinds)):
            return None, None, "a part is missing or of another kind"
        body = dict(zip(BODY, [VERSION, kind, issued_at, parts[0][1], parts[1][1], parts[2][1], parts[3][1]]))
        try:
            found = digest(body)
        except (ValueError, RecursionError):
            return None, None, "the body has no digest"
        row = {"evt": "receipt", "kind": kind, "body_digest": found, "checks": len(parts[1][1])}
        return json.dumps({**body, "body_digest": found}, ensure_ascii=False), json.dumps(row, ensure_ascii=False), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(3, 8)))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], *[pa.array([m[i] for m in made], pa.string()) for i in range(3)]], names=["id", "ledger_id", "n", "document", "row", "problem"])

    kind = bodies.schema["id"].dataType.simpleString()
    given = bodies.select("id", F.col("ledger_id").cast("string"), F.col("n").cast("long"), "kind", "subject", "checks", "scope", "extra")
    made = given.mapInArrow(run, f"id {kind}, ledger_id string, n long, document string, row string, problem string")
    scope = made.join(given.select("id", _stated(F.get_json_object("scope", "$.proves")).alias("p"), _stated(F.get_json_object("scope", "$.does_not_prove")).alias("q")), "id")
    made = settled(scope.withColumn("problem", F.coalesce("problem", F.when(~(F.col("p") & F.col("q")), "the scope is not stated"), F.when(F.col("ledger_id").isNull() | F.col("n").isNull(), "no place"))))
    good = made.where("problem is null")
    appending.append(spark, folder, good.select("ledger_id", "n", F.col("row").alias("raw")), stamp=True, now=issued_at)
    rows = placed(read_rows(appending.read(spark, folder)).where("state = 'row'"))
    where = rows.select("ledger_id", F.get_json_object("body", "$.body_digest").alias("d"), F.struct(F.col("n").alias("rows"), "chain").alias("at")).groupBy("ledger_id", "d").agg(F.max("at").alias("at"))
    met = good.withColumn("d", F.get_json_object("document", "$.body_digest")).join(where, ["ledger_id", "d"])
    block = F.to_json(F.struct(F.struct(F.col("ledger_id").alias("namespace"), "at.rows", "at.chain").alias("ledger"), F.struct(F.lit("skipped").alias("status")).alias("witness")))
    raw = F.concat(F.expr("substring(document, 1, length(document) - 1)"), F.lit(", "), F.expr("substring({0}, 2)".format("block")))
    return met.withColumn("block", block).select("id", "ledger_id", raw.alias("raw")), made.where("problem is not null").select("id", "problem")
