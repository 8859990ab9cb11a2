"""Helpers of the llm operators: tables, shared storage, folds, Arrow columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a local master, whose executors are this one process,
    gets a temporary folder that goes with the process; a cluster has no folder
    of its own to fall back to, and is refused (ValueError).
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir("file://" + folder)
        found = context.getCheckpointDir()
    return found.rstrip("/")


_RUN = uuid.uuid4().hex
_FOLDERS = [_RUN]
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage.

    The written rows no longer depend on any executor's local files, and keys
    made while writing (partition ids, running numbers) are fixed from then on.
    Spark removes the shuffles of the write at its end, as nothing reads them
    any more. Results read what is written, so it stays until `clear` is called
    or the `settled` around it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{'/'.join(_FOLDERS)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, step: Callable[[], DataFrame]) -> DataFrame:
    """The written result of a step, without the tables that the step wrote on the way; steps may be nested, in one thread."""
    inner = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/plumbline/{'/'.join(_FOLDERS)}/{inner}"
    try:
        _FOLDERS.append(inner)
        try:
            found = step()
        finally:
            _FOLDERS.pop()
        return materialize(found)
    finally:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this process has written to the shared folder; results not yet read are lost."""
    _delete(spark, f"{shared_dir(spark)}/plumbline/{_RUN}")


def bounded(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """df, broadcast if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def binary_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a text column; nulls have length zero."""
    column = batch.column(batch.schema.get_field_index(name))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, lengths = edges[:-1], np.diff(edges)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), lengths, 0)
    return raw, starts, lengths


def texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """UTF-8 bytes of each row of a text column; null counts as empty."""
    raw, starts, lengths = binary_column(batch, name)
    data = memoryview(raw)
    for start, length in zip(starts.tolist(), lengths.tolist()):
        yield data[start : start + length].tobytes()


def small_batches(df: DataFrame, size: int = 8 << 20) -> DataFrame:
    """df itself, with the session's Arrow batches held to `size` bytes (a row at least).

    Texts vary from nothing to megabytes, so a limit by rows would not bound
    the memory of a Python worker and of the buffers that feed it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(conf.get(key)) <= size:
        conf.set(key, str(size))
    return df


def _bytes(setting: str) -> int:
    number = setting.strip().lower().removesuffix("b")
    return int(number) if number.lstrip("-").isdigit() else -1


def pieces(batches: Iterator[pa.RecordBatch], name: str, max_bytes: int = 16 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text size (one row at least)."""
    for batch in batches:
        _, _, lengths = binary_column(batch, name)
        done, held = 0, 0
        for i, length in enumerate(lengths.tolist()):
            if i > done and (held + length > max_bytes or i - done >= max_rows):
                yield batch.slice(done, i - done)
                done, held = i, 0
            held += length
        if batch.num_rows > done:
            yield batch.slice(done)
    pa.default_memory_pool().release_unused()


def with_columns(batch: pa.RecordBatch, keep: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    """Some columns of a batch and new ones."""
    arrays = [batch.column(batch.schema.get_field_index(k)) for k in keep]
    return pa.RecordBatch.from_arrays(arrays + list(more.values()), names=keep + list(more))
