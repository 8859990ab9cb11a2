"""Packing token sequences into as few bins as it can: best-two-fit.

A bin takes the longest unpacked document and then, again and again, the
longest that still fits. If a gap is left, its smallest document makes way for
two unpacked ones that fill the widened gap more tightly, as long as there are
such two. Documents of one length are alike, so the plan is made on the counts
of the (at most `capacity`) lengths: a filling is repeated as often as the
counts allow the same choices. The plan says which ranks of a length go to
which bins; every piece then finds its bin by its length and its rank.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import materialize, pieces, small_batches, texts, with_columns
from plumbline.llm.tokens import encode

CAPACITY = 1024
END = 2


def fill(counts: np.ndarray, capacity: int) -> Counter:
    """One bin's lengths, best-two-fit, from counts[length] of unpacked documents."""
    available = np.flatnonzero(counts)
    used: Counter = Counter()
    gap = capacity

    def left(length: int) -> int:
        return int(counts[length]) - used[length]

    def greedy() -> None:
        nonlocal gap
        top = int(np.searchsorted(available, gap, "right")) - 1
        while top >= 0 and gap >= available[0]:
            length = int(available[top])
            take = min(gap // length, left(length))
            if take:
                used[length] += take
                gap -= take * length
            top = min(top - 1, int(np.searchsorted(available, gap, "right")) - 1)

    greedy()
    while gap and len(used) + (max(used.values()) > 1) > 1:
        smallest = min(used)
        pair = two_fit(counts, used, gap + smallest, smallest)
        if pair is None:
            break
        used[smallest] -= 1
        used.update(pair)
        used += Counter()
        gap += smallest - sum(pair)
        greedy()
    return used


def two_fit(counts: np.ndarray, used: Counter, room: int, beat: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum of at most `room`, if above `beat`."""
    free = counts[: room + 1].copy()
    for length, n in used.items():
        if length <= room:
            free[length] -= n
    below = np.where(free > 0, np.arange(room + 1), 0)
    below = np.maximum.accumulate(below)  # the largest unpacked length up to each number
    first = np.flatnonzero(free > 0)
    first = first[first < room]
    if not len(first):
        return None
    limit = np.minimum(first, room - first)
    second = below[limit]
    alone = (second == first) & (free[first] < 2)
    second = np.where(alone, below[np.maximum(np.minimum(limit, first - 1), 0)], second)
    total = np.where(second > 0, first + second, 0)
    best = int(total.argmax())
    return (int(first[best]), int(second[best])) if total[best] > beat else None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """For each length, runs (first rank, first bin, offset) in order of rank; and the number of bins.

    A run goes on until the next one begins: its k-th piece goes to bin first + k.
    """
    counts = counts.astype(np.int64).copy()
    runs: dict[int, list[tuple[int, int, int]]] = {int(n): [] for n in np.flatnonzero(counts)}
    spent: Counter = Counter()
    bins = 0
    while counts.any():
        used = fill(counts, capacity)
        times = min(int(counts[n]) // k for n, k in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            for _ in range(used[length]):
                runs[length].append((spent[length], bins, offset))
                spent[length] += times
                offset += length
            counts[length] -= times * used[length]
        bins += times
    return runs, bins


def cut(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """Pieces of every row: doc_id, piece, start, length, ids_crc32; and the
    writing task and the piece's rank among the task's pieces of its length.

    A null text is an empty one; every text has the end id, so no piece is
    empty. Only texts of more than `capacity` ids are cut, the first piece
    taking what the full ones leave.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in pieces(batches, "text", max_bytes=4 << 20):
            owner, rows = [], []
            for i, raw in enumerate(texts(batch, "text")):
                ids = np.append(encode(raw.decode("utf-8", "replace"), path), np.uint32(end)).astype("<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    owner.append(i)
                    rows.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes()), seen[b - a]))
                    seen[b - a] += 1
            at = np.array(rows, np.int64).reshape(-1, 5).T
            new = {"piece": pa.array(at[0].astype(np.int32)), "start": pa.array(at[1]), "length": pa.array(at[2]), "ids_crc32": pa.array(at[3]), "local": pa.array(at[4]), "task": pa.array(np.full(len(rows), task, np.int32))}
            yield with_columns(batch.take(pa.array(owner, pa.int64())), ["doc_id"], new)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(n, T.IntegerType() if n in ("piece", "task") else T.LongType()) for n in ("piece", "start", "length", "ids_crc32", "local", "task")])
    return docs.select("doc_id", "text").transform(small_batches).mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    An empty table gives an empty result; repeated rows are packed as often as
    they come. Only the counts of the lengths, at most `capacity` numbers,
    reach the driver, and the plan made from them goes to the tasks.
    """
    found = materialize(cut(docs, capacity, end, path))
    per_task = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "task", "base")
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    runs, _ = plan(counts, capacity)
    tables = {n: np.array(r, np.int64).T for n, r in runs.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.asarray(batch.column(batch.schema.get_field_index("rank")))
            length = np.asarray(batch.column(batch.schema.get_field_index("length")))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                ranks, bins, offsets = tables[int(n)]
                run = np.searchsorted(ranks, rank[at], "right") - 1
                sequence[at], offset[at] = bins[run] + rank[at] - ranks[run], offsets[run]
            yield with_columns(batch, keep, {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = found.join(base, ["length", "task"]).select(*keep, (F.col("base") + F.col("local")).alias("rank"))
    schema = T.StructType([found.schema[n] for n in keep] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)
