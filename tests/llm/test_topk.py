"""Exact search against a plain scan."""

import math

import numpy as np

from plumbline.llm import topk


def plain(rows, modulus=20, k=20):
    ok = [(n, i, [math.floor(64 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for n, i, v in ok:
        if i % modulus == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in ok if m != n)
            found += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(found)


def test_real_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = sorted(tuple(r) for r in topk.search(df, block_rows=32).collect())
    assert got == plain(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 5)]) for i in range(90)]
    rows += [(100, None), (120, []), (140, [1.0, None]), (160, [float("nan"), 1.0]), (180, [float("inf")]), (None, [1.0]), (200, [1.0, 2.0]), (201, [0.5] * 9), (20, rows[20][1]), (220, [0.0] * 5)]
    rows += [(300 + i, [0.25] * 5) for i in range(60)]
    schema = "vec_id long, embedding array<float>, score string"
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    for settings in ({"block_rows": 7}, {"block_rows": 1000}, {"block_rows": 5, "ranges": 3}):
        assert sorted(tuple(r) for r in topk.search(df, **settings).collect()) == plain(rows)
    assert topk.search(df.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0], ""), (1, [2.0], "")], schema)
    assert [tuple(r) for r in topk.search(few).collect()] == [(0, 1, 1, 64 * 128)]


def test_large_components_stay_exact():
    a = np.array([[2**40, -3], [5, 2**62]], np.int64)
    b = np.array([[2**20, 7], [2**62, 2**62]], np.int64)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert topk.products(a, b).tolist() == np.clip(np.array(want, object), *topk.LONGS).tolist()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    q, v = rng.integers(-40, 40, (20, 16)), rng.integers(-40, 40, (300, 16))
    parts = np.array_split(v, 10)
    top, low = np.stack([np.maximum(p.max(0), 0) for p in parts]), np.stack([np.minimum(p.min(0), 0) for p in parts])
    bound = topk.upper_bounds(q, top, low)
    assert all((bound[:, i] >= (q @ p.T).max(1)).all() for i, p in enumerate(parts))


def test_very_many_ties(spark):
    rows = [(i, [1.0, 2.0]) for i in range(3000)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), modulus=1000, block_rows=64).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(q, n, v) for q in (0, 1000, 2000) for n, v in enumerate([i for i in range(21) if i != q][:20], 1)]


def test_bounds_prune_where_vectors_differ_in_length(spark):
    """Only the block of long vectors is scored in the last round: the rest can't reach the k-th score."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(abs(x) * (50 if i < 40 else 0.5))) for x in rng.normal(0, 1, 4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.search(df, block_rows=40).collect()) == plain(rows)
    index = topk.blocks(topk.quantized(df), 10, 40)
    bounds = sorted(topk.range_bounds(index).collect())
    queries = topk._as_bytes(topk.quantized(df).where("vec_id % 20 = 0")).selectExpr("row", "vec_id", "vector", "60000L as least", "0L as least_id")
    top, low = topk._matrix([bytes(b["top"]) for b in bounds]), topk._matrix([bytes(b["low"]) for b in bounds])
    due = topk.due(queries, np.array([b["block"] for b in bounds], np.int32), top, low, 0, len(bounds))
    assert 0 < due.count() < 0.6 * queries.count() * len(bounds)
