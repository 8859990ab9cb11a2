"""Ledgers exported as audit-trail records: only what a row holds, in canonical bytes, under a second chain, with every gap named."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.canon import digest, jcs, parse
from plumbline.functions.fold import column_fold

#: Fields of a record that a row may fill, and kinds of events by the action they are.
FIELDS = ("timestamp", "agent_id", "session_id", "action_type", "action_detail", "response_hash", "input_hash", "output_hash", "outcome", "sequence_number", "recording_component")
LIFECYCLE = ("session_begin", "session_end", "mcp_initialize", "tools_list", "system_start", "system_stop")
DECISION = ("decision", "mandate_outside", "mandate_could_not_look", "mandate_cap_exceeded")
OUTCOMES = {"ok": "success", "error": "failure"}
AGENT = "urn:agent:"
RECORD = "ledger_id string, line long, record string, refused array<string>"


def _action(row: dict) -> str | None:
    kind = row.get("evt") or row.get("event")
    groups = {"tool_call": ("tool_call",), "decision": DECISION, "lifecycle": LIFECYCLE}
    return "error" if row.get("record_error") else next((a for a, kinds in groups.items() if kind in kinds), None)


def _hash(row: dict, key: str) -> str | None:
    try:
        return digest(row[key]) if key in row else None
    except (ValueError, RecursionError):
        return None


def _record(row: dict, line: int) -> dict:
    text = lambda key: row[key] if isinstance(row.get(key), str) else None
    agent = text("agent") or text("system_id")
    detail = {k: v for k, v in (("tool_name", text("tool")), ("parameters_hash", text("args_digest"))) if v is not None}
    seq, seam, by = row.get("seq"), text("seam"), text("seam_impl")
    status = text("status")
    denied = row.get("action") == "blocked" and row.get("mandate_mode") == "enforce"
    found = {
        "timestamp": text("ts"),
        "agent_id": AGENT + quote(agent, safe="") if agent else None,
        "session_id": text("session"),
        "action_type": _action(row),
        "action_detail": detail or None,
        "response_hash": text("result_digest"),
        "input_hash": _hash(row, "inputs"),
        "output_hash": _hash(row, "outputs"),
        "outcome": "denied" if denied else OUTCOMES.get(status),
        "sequence_number": seq if isinstance(seq, int) and not isinstance(seq, bool) else None,
        "recording_component": None if seam is None else f"proxy ({seam}, {by})" if by else f"proxy ({seam})",
        "chain": text("chain"),
        "source_line": line,
    }
    return {k: v for k, v in found.items() if v is not None}


def _exact(value: object) -> bool:
    try:
        jcs(value)
    except (ValueError, RecursionError):
        return False
    return True


def records(lines: DataFrame) -> DataFrame:
    """(RECORD) of ledger lines (ledger_id, line, raw): the record as canonical JSON, null for lines that are no object.

    refused: fields whose value has no canonical form (whole numbers beyond
    2**53, lone surrogates); they are left out, not rounded. Blank lines are no
    rows.
    """

    def one(line: int, raw: str) -> tuple[str | None, list[str]]:
        ok, row = parse(raw)
        if not ok or not isinstance(row, dict):
            return None, []
        found = _record(row, line)
        try:
            return jcs(found), []
        except (ValueError, RecursionError):
            bad = [k for k, v in found.items() if not _exact(v)]
        return jcs({k: v for k, v in found.items() if k not in bad}), bad

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(n, r) for n, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.string()))], names=["ledger_id", "line", "record", "refused"])

    rows = lines.select("ledger_id", F.col("line").cast("long"), "raw").where(F.trim(F.coalesce("raw", F.lit(""))) != "")
    return rows.mapInArrow(run, RECORD)


def exported(made: DataFrame) -> DataFrame:
    """(ledger_id, line, raw) of records (RECORD): each with `prev_hash`, the sha256 of the exported line before (null first), as canonical bytes."""

    def step(previous: str | None, record: str) -> tuple[str, tuple]:
        raw = jcs({**json.loads(record), "prev_hash": previous})
        return hashlib.sha256(raw.encode()).hexdigest(), (raw,)

    rows = made.where("record is not null").select("ledger_id", "line", "record")
    chained = column_fold(rows, ["ledger_id"], ["line"], ["record"], lambda: None, step, T.StructType([T.StructField("raw", T.StringType())]))
    return chained.select("ledger_id", "line", "raw")


def gaps(made: DataFrame) -> DataFrame:
    """(ledger_id, field, why, n, first): what records leave out, how often, and on which line first.

    why: not_held (the row has no value, and none is guessed), not_exact (it has
    no canonical form), or no_object (the whole line is none; field is null).
    """
    whole = made.where("record is not null")
    absent = whole.select("ledger_id", "line", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"), "record", "refused")
    absent = absent.where(~F.array_contains("refused", F.col("field")) & ~F.array_contains(F.json_object_keys("record"), F.col("field"))).select("ledger_id", "line", "field", F.lit("not_held").alias("why"))
    inexact = whole.select("ledger_id", "line", F.explode("refused").alias("field"), F.lit("not_exact").alias("why"))
    none = made.where("record is null").select("ledger_id", "line", F.lit(None).cast("string").alias("field"), F.lit("no_object").alias("why"))
    return absent.unionAll(inexact).unionAll(none).groupBy("ledger_id", "field", "why").agg(F.count("*").alias("n"), F.min("line").alias("first"))


def verified(lines: DataFrame) -> DataFrame:
    """(ledger_id, records, first_bad, finding) of exported lines (ledger_id, n: from 1, raw).

    finding, of the first bad line: not_object, not_canonical (its bytes aren't
    its own canonical form), or broken (prev_hash isn't the hash of the line
    before). Every line is checked by itself against the one before it, so a
    trail is many tasks; nulls where nothing is bad.
    """

    def one(raw: str | None) -> tuple[str | None, str | None]:
        ok, row = parse(raw) if raw is not None else (False, None)
        if not ok or not isinstance(row, dict):
            return "not_object", None
        try:
            same = jcs(row) == raw
        except (ValueError, RecursionError):
            same = False
        previous = row.get("prev_hash", "absent")
        return None if same else "not_canonical", "null" if previous is None else str(previous)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(r) for r in batch.column(2).to_pylist()]
            new = [pa.array([m[i] for m in made], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=["ledger_id", "n", "form", "previous"])

    rows = lines.select("ledger_id", F.col("n").cast("long"), "raw")
    read = rows.mapInArrow(run, "ledger_id string, n long, form string, previous string")
    before = rows.select("ledger_id", (F.col("n") + 1).alias("n"), F.sha2("raw", 256).alias("want"))
    met = read.join(before, ["ledger_id", "n"], "left").withColumn("want", F.when(F.col("n") == 1, "null").otherwise(F.col("want")))
    finding = F.coalesce("form", F.when(~F.col("previous").eqNullSafe(F.col("want")), "broken"))
    bad = F.when(finding.isNotNull(), F.col("n"))
    return met.groupBy("ledger_id").agg(F.count("*").alias("records"), F.min(bad).alias("first_bad"), F.min_by(finding, bad).alias("finding"))
