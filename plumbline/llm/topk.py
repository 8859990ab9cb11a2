"""Exact top-k search by inner product, block at a time.

Vectors are rounded to integers and cut into ranges of ids. A range is one or
more blocks of at most `block_rows` vectors, each with a forward index (its
vectors in order of id) and, for every component, its largest and smallest
value. For a query, a block's bound is the sum over the components of the larger
of component times largest and component times smallest: no vector of the block
scores more. A range's bound comes from its blocks. Every query goes through the
ranges in falling order of their bounds, in rounds that grow, and stops when the
bound falls below the k-th best score so far; within a range it skips the blocks
whose own bound does. The queries are a stated set, so this is no join of all
with all.

There are at most MAX_RANGES ranges, whatever the table's size, so their bounds
fit the driver and every task; blocks have a bounded size at any number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

SCALE = 64
MAX_RANGES = 4096  # so the bounds' table is at most this many rows
PACK = 2048
LONGS = (-(1 << 63), (1 << 63) - 1)
BLOCK = "block int, rows binary, ids binary, n int, width int, matrix binary, top binary, low binary"
QUERY = "row long, vec_id long, vector binary"


def quantized(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): floor(64 * x) of each component, of the rows that take part.

    Rows without a vec_id, without a vector, or with a component that is null
    or not finite take no part; components beyond 64 bits count as the nearest
    long.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return materialize(kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")))


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, edges = np.asarray(column.flatten(), np.int64), np.asarray(column.offsets)
    edges = edges - edges[0]
    return [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]


def blocks(points: DataFrame, count: int, block_rows: int) -> DataFrame:
    """Blocks of `count` ranges of ids; `block` is the range's number. Vectors shorter than the block's longest get zeros behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, vectors = [], [], []

        def out(n: int) -> pa.RecordBatch:
            width = max(map(len, vectors[:n]))
            matrix = np.zeros((n, width), np.int64)
            for i, v in enumerate(vectors[:n]):
                matrix[i, : len(v)] = v
            top, low = np.maximum(matrix.max(0), 0), np.minimum(matrix.min(0), 0)  # queries may be wider or narrower
            values = [TaskContext.get().partitionId(), np.array(rows[:n], np.int64).tobytes(), np.array(ids[:n], np.int64).tobytes(), n, width, matrix.tobytes(), top.tobytes(), low.tobytes()]
            del rows[:n], ids[:n], vectors[:n]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=BLOCK.replace(",", "").split()[::2])

        for batch in batches:
            rows += batch.column(0).to_pylist()
            ids += batch.column(1).to_pylist()
            vectors += _lists(batch.column(2))
            while len(rows) > block_rows:
                yield out(block_rows)
        if rows:
            yield out(len(rows))

    ranged = points.select("row", "vec_id", "v").repartitionByRange(count, "vec_id", "row").sortWithinPartitions("vec_id", "row")
    return materialize(ranged.mapInArrow(run, BLOCK))


def range_bounds(index: DataFrame) -> DataFrame:
    """(block, top, low) of each range, over its blocks."""

    def widest(group: pa.Table) -> pa.Table:
        top, low = (_matrix(group.column(c).to_pylist()) for c in ("top", "low"))
        return pa.table({"block": group.column("block")[:1], "top": pa.array([top.max(0).tobytes()], pa.binary()), "low": pa.array([low.min(0).tobytes()], pa.binary())})

    return index.select("block", "top", "low").groupBy("block").applyInArrow(widest, "block int, top binary, low binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integer matrices; results beyond 64 bits count as the nearest long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    largest = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    most = largest(a) * largest(b) * max(1, width)
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, *LONGS).astype(np.int64)


def upper_bounds(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(queries, blocks): no vector of the block scores more."""
    width = min(queries.shape[1], top.shape[1])
    up, down = np.maximum(queries[:, :width], 0), np.minimum(queries[:, :width], 0)
    a, b = products(up, top[:, :width]), products(down, low[:, :width])
    whole = a + b  # both are at least 0, so a sum beyond a long turns negative
    return np.where(whole < 0, LONGS[1], whole)


def _matrix(parts: list[bytes]) -> np.ndarray:
    vectors = [np.frombuffer(p, np.int64) for p in parts]
    found = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        found[i, : len(v)] = v
    return found


def due(queries: DataFrame, numbers: np.ndarray, top: np.ndarray, low: np.ndarray, first: int, last: int) -> DataFrame:
    """(block, row, vector, least, least_id) of the ranges that are next in each query's own order, from `first` to `last`.

    queries: row, vec_id, vector, least and least_id (the k-th best score so far and its id, if there are k).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                vectors = part.column(1).to_pylist()
                least = np.array([LONGS[0] if x is None else x for x in part.column(2).to_pylist()], np.int64)
                bound = upper_bounds(_matrix(vectors), top, low)
                order = np.argsort(-bound.astype(float), axis=1, kind="stable")[:, first:last]
                q = np.repeat(np.arange(len(vectors)), order.shape[1])
                b = order.ravel()
                use = bound[q, b] >= least[q]
                q, b = q[use], b[use]
                chosen = [part.column(c).take(pa.array(q)) for c in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(numbers[b]), *chosen[:2], pa.array(least[q]), chosen[2]], names=["block", "row", "vector", "least", "least_id"])

    return queries.select("row", "vector", "least", "least_id").mapInArrow(run, "block int, row long, vector binary, least long, least_id long")


def packed(pairs: DataFrame, parts: int) -> DataFrame:
    """The queries due at each block, at most PACK in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> pa.RecordBatch:
            block, rows, vectors = held[0][0], [h[1] for h in held], [h[2] for h in held]
            matrix, least = _matrix(vectors), [[h[3], LONGS[1] if h[4] is None else h[4]] for h in held]
            values = [block, np.array(rows, np.int64).tobytes(), matrix.tobytes(), matrix.shape[1], np.array(least, np.int64).T.tobytes()]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["to", "qrows", "qmatrix", "qwidth", "least"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0] != held[0][0] or len(held) == PACK):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    dealt = pairs.repartition(parts, "block", F.pmod("row", F.lit(8))).sortWithinPartitions("block", "row")
    return dealt.mapInArrow(run, "to int, qrows binary, qmatrix binary, qwidth int, least binary")


def scored(pack: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(row, other, vec_id, score): of each query and block the k best that are better than the query's k-th so far."""
    joined = pack.join(index, F.col("to") == F.col("block"))
    names = ["rows", "ids", "width", "matrix", "top", "low", "qrows", "qmatrix", "qwidth", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, ids, top, low, qrows, least = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids", "top", "low", "qrows", "least"))
                index_matrix = np.frombuffer(r["matrix"], np.int64).reshape(len(rows), r["width"])
                queries, least = np.frombuffer(r["qmatrix"], np.int64).reshape(len(qrows), r["qwidth"]), least.reshape(2, -1)
                use = np.flatnonzero(upper_bounds(queries, top[None], low[None])[:, 0] >= least[0])
                for i in range(0, len(use), 128):
                    part = use[i : i + 128]
                    yield _best(products(queries[part], index_matrix), qrows[part], least[:, part], rows, ids, k)

    return joined.select(*names).mapInArrow(run, "row long, other long, vec_id long, score long")


def _best(scores: np.ndarray, qrows: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> pa.RecordBatch:
    q, n = scores.shape
    better = (scores > least[0][:, None]) | (scores == least[0][:, None]) & (ids[None, :] < least[1][:, None])
    use = better & (rows[None, :] != qrows[:, None])
    if n > k:
        largest = max(abs(int(scores.max(initial=0))), abs(int(scores.min(initial=0))))
        if largest < (1 << 61) // n:  # ties to the smaller id, which comes first
            key = np.where(use, scores * n + (n - 1 - np.arange(n)), -(1 << 62))
            at = np.argpartition(-key, k - 1, axis=1)[:, :k]
        else:
            at = np.stack([np.lexsort((np.arange(n), -s.astype(object)))[:k] for s in np.where(use, scores, LONGS[0])])
    else:
        at = np.repeat(np.arange(n)[None], q, 0)
    own = np.repeat(np.arange(q), at.shape[1])
    at = at.ravel()
    keep = use[own, at]
    own, at = own[keep], at[keep]
    return pa.RecordBatch.from_arrays([pa.array(qrows[own]), pa.array(rows[at]), pa.array(ids[at]), pa.array(scores[own, at])], names=["row", "other", "vec_id", "score"])


def search(vectors: DataFrame, modulus: int = 20, k: int = 20, block_rows: int = 4096, rounds: tuple[int, ...] = (1, 8, 64), ranges: int = MAX_RANGES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each query.

    Queries are the rows whose vec_id is divisible by `modulus`; a query's own
    row is no candidate of its own, a copy of it is. Ties go to the smaller
    vec_id. Vectors of unlike lengths meet as if the shorter had zeros behind.
    A query with fewer than k candidates gets all of them; a repeated query
    gets its results as often as it comes. `ranges` bounds the ranges of ids
    and `block_rows` the vectors of a block; neither changes a result.
    """
    points = quantized(vectors)
    count = points.count()
    index = blocks(points, max(1, min(ranges, -(-count // block_rows))), block_rows)
    bounds = sorted(range_bounds(index).collect())  # at most MAX_RANGES rows, a range's two vectors each
    numbers = np.array([b["block"] for b in bounds], np.int32)
    top, low = _matrix([bytes(b["top"]) for b in bounds]), _matrix([bytes(b["low"]) for b in bounds])
    queries = _as_bytes(points.where(F.pmod("vec_id", F.lit(modulus)) == 0))
    parts = max(len(bounds), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    best = None
    edges = [0, *(e for e in rounds if e < len(bounds)), max(1, len(bounds))]
    place = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other")
    for first, last in zip(edges, edges[1:]):
        now = queries.withColumns({"least": F.lit(None).cast("long"), "least_id": F.lit(None).cast("long")})
        if best is not None:
            least = best.where(F.col("rank") == k).select("row", F.col("score").alias("least"), F.col("vec_id").alias("least_id"))
            now = queries.join(least, "row", "left")
        found = scored(packed(due(now, numbers, top, low, first, last), parts), index, k)
        if best is not None:
            found = found.unionAll(best.select("row", "other", "vec_id", "score"))
        best = materialize(found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k))
    named = queries.select("row", F.col("vec_id").alias("query_id"))
    return best.join(named, "row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _as_bytes(points: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in _lists(batch.column(2))], pa.binary())], names=["row", "vec_id", "vector"])

    return materialize(points.select("row", "vec_id", "v").mapInArrow(run, QUERY))
