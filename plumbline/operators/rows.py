"""Ledgers of JSON lines: what each line holds, and the chain over canonical row text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.canon import parse
from plumbline.operators import chain

SCHEMA = "ledger_id string, line long, raw string, body string, chain string, state string"


def read_rows(lines: DataFrame) -> DataFrame:
    """(ledger_id, line, raw, body, chain, state) of lines (ledger_id, line, raw) of any source.

    state: row, blank, unreadable (no JSON, torn, or a key twice in one object),
    or no_object. body is the row without its chain as the link is taken over:
    keys sorted, text as it is. A chain that isn't text counts as none.
    """

    def one(raw: str | None) -> tuple[str | None, str | None, str]:
        if raw is None or not raw.strip():
            return None, None, "blank"
        ok, value = parse(raw, unique_keys=True)
        if not ok or not isinstance(value, dict):
            return None, None, "no_object" if ok else "unreadable"
        body = json.dumps({k: v for k, v in value.items() if k != "chain"}, sort_keys=True, ensure_ascii=False)
        claimed = value.get("chain")
        try:
            body.encode()
        except UnicodeEncodeError:
            return None, None, "unreadable"
        return body, claimed if isinstance(claimed, str) else None, "row"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(r) for r in batch.column(2).to_pylist()]
            new = [pa.array([f[i] for f in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=["ledger_id", "line", "raw", "body", "chain", "state"])

    return lines.select("ledger_id", "line", "raw").mapInArrow(run, SCHEMA)


def verify_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """chain.verify over the rows of JSON lines, and how many lines could not be read as rows. Blank lines are no rows."""
    read = read_rows(lines)
    rows = chain.verify(read.where("state = 'row'").drop("state"), strict=strict)
    bad = read.groupBy("ledger_id").agg(F.count_if(F.col("state").isin("unreadable", "no_object")).alias("unreadable"))
    return rows.join(bad, "ledger_id")


def append(rows: DataFrame) -> DataFrame:
    """The JSON lines of rows (ledger_id, line, body: canonical JSON object text), each with its chain put in."""
    built = chain.build(rows.select("ledger_id", "line", "body"))
    inner = F.expr("substring(body, 1, length(body) - 1)")
    return built.withColumn("raw", F.concat(inner, F.when(F.length("body") > 2, ", ").otherwise(""), F.lit('"chain": "'), "chain", F.lit('"}')))
