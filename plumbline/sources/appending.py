"""Ledgers that grow by whole batches: appended rows are stamped, chained from each ledger's head, and seen together or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.canon import GENESIS, link, parse
from plumbline.functions.fold import column_fold
from plumbline.operators import chain
from plumbline.operators.rows import read_rows
from plumbline.session import settled

SCHEMA = "ledger_id string, line long, raw string"
COMMITS = "_commits"
SHOWN = 20


class Refused(ValueError):
    """Nothing was appended."""


def _path(spark: SparkSession, *parts: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def batches(spark: SparkSession, folder: str) -> list[str]:
    """Folders of the batches that were committed, in order; others that may lie there are none of the ledger."""
    files, path = _path(spark, folder, COMMITS)
    if not files.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName().endswith(".json"))
    found = []
    for name in names:
        stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(path, name))
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found.append(f"{folder}/{json.loads(text)['batch']}")
    return found


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(ledger_id, line, raw) of every committed row; a folder without batches is empty."""
    found = batches(spark, folder)
    return spark.read.schema(SCHEMA).parquet(*found) if found else spark.createDataFrame([], SCHEMA)


def heads(spark: SparkSession, folder: str) -> DataFrame:
    """(ledger_id, rows, head) of the committed rows."""
    return chain.heads(read_rows(read(spark, folder)).where("state = 'row'"))


def stamped(records: DataFrame, now: str | None) -> DataFrame:
    """(ledger_id, n, raw, body, problem): each record's row without its chain, with a `ts` where it has none.

    problem: why a record can't be a row (unreadable, no_object, no_ledger,
    not_text for text that UTF-8 can't hold), else null. A `chain` that a record
    brings along is dropped. Without `now` nothing is stamped.
    """

    def one(ledger_id: str | None, raw: str | None) -> tuple[str | None, str | None]:
        ok, value = parse(raw, unique_keys=True) if raw is not None else (False, None)
        if not ok or not isinstance(value, dict):
            return None, "no_object" if ok else "unreadable"
        value.pop("chain", None)
        if now is not None:
            value.setdefault("ts", now)
        text = json.dumps(value, ensure_ascii=False)
        try:
            text.encode()
        except UnicodeEncodeError:
            return None, "not_text"
        return text, "no_ledger" if ledger_id is None else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [one(*row) for row in zip(part.column(0).to_pylist(), part.column(2).to_pylist())]
            new = [pa.array([f[i] for f in found], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=["ledger_id", "n", "raw", "body", "problem"])

    rows = records.select(F.col("ledger_id").cast("string"), F.col("n").cast("long"), F.col("raw").cast("string"))
    return rows.mapInArrow(run, "ledger_id string, n long, raw string, body string, problem string")


def append(spark: SparkSession, folder: str, records: DataFrame, stamp: bool = True, now: str | None = None) -> DataFrame:
    """Appends records (ledger_id, n, raw: a JSON object's text) in order of n, and returns what each of their ledgers is now.

    (ledger_id, appended, rows, head, ok): `ok` is what verifying the ledger
    says after the batch, read back from the store. All records are checked
    before any is written: one bad record refuses the batch, and the error names
    the first of them and how many there are. Rows chain from the head that
    their ledger has; repeated n stand in the order of their text.

    The batch is written to a folder of its own first and becomes part of the
    ledgers when its number is taken in `_commits`, which one writer alone can
    do: who comes second is refused and may try again. A task or driver that
    fails leaves a folder that no commit names.
    """
    number = len(batches(spark, folder))
    now = (now or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")) if stamp else None
    checked = settled(stamped(records, now))
    bad = checked.where("problem is not null")
    shown = bad.orderBy("ledger_id", "n").limit(SHOWN).collect()
    if shown:
        listed = ", ".join(f"{r['ledger_id']}:{r['n']} {r['problem']}" for r in shown)
        raise Refused(f"{bad.count()} records can't be rows: {listed}")
    head = heads(spark, folder)

    def step(state: tuple[str, int] | None, body: str, previous: str | None, rows: int | None) -> tuple[tuple[str, int], tuple]:
        before, line = state or (previous or GENESIS, rows or 0)
        value = json.loads(body)
        value["chain"] = link(before, value)
        return (value["chain"], line + 1), (line + 1, json.dumps(value, ensure_ascii=False))

    ready = checked.join(head, "ledger_id", "left").select("ledger_id", "n", "body", "head", "rows")
    added = spark.createDataFrame([], "line long, made string").schema
    made = column_fold(ready, ["ledger_id"], ["n", "body"], ["body", "head", "rows"], lambda: None, step, added)
    name = f"batch-{uuid.uuid4().hex}"
    made.select("ledger_id", "line", F.col("made").alias("raw")).write.parquet(f"{folder}/{name}")
    _commit(spark, folder, number, name)
    touched = spark.read.schema(SCHEMA).parquet(f"{folder}/{name}").groupBy("ledger_id").agg(F.count("*").alias("appended"))
    now_rows = read_rows(read(spark, folder).join(touched.select("ledger_id"), "ledger_id", "left_semi"))
    verdict = chain.verify(now_rows.drop("state"))
    return touched.join(chain.heads(now_rows), "ledger_id").join(verdict.select("ledger_id", "ok"), "ledger_id")


def _commit(spark: SparkSession, folder: str, number: int, name: str) -> None:
    files, path = _path(spark, folder, COMMITS, f"{number:020d}.json")
    try:
        stream = files.create(path, False)  # fails if another writer has taken the number
    except Exception as e:
        if not files.exists(path):
            raise
        raise Refused(f"batch {number} of {folder} was appended by another writer") from e
    try:
        stream.write(bytearray(json.dumps({"batch": name}).encode()))
    finally:
        stream.close()


def adopt(lines: DataFrame) -> DataFrame:
    """Records of lines (ledger_id, line, raw) of files that other writers left, for a first batch: what reads as a row, in order.

    A torn last line is a line of its own, so it takes no later row with it; it
    and other lines that are no rows have no place in a chain and stay behind.
    """
    order = Window.partitionBy("ledger_id").orderBy("line")
    return read_rows(lines).where("state = 'row'").select("ledger_id", F.row_number().over(order).cast("long").alias("n"), "raw")
