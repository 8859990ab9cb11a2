"""Shards against a plain search over all capacities, on odd tables and real ones."""

import zlib
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import queries, sharding


def plain_capacity(sizes, shards):
    def used(capacity):
        n, load = 1, 0
        for s in sizes:
            if s > capacity:
                return shards + 1
            n, load = (n, load + s) if load + s <= capacity else (n + 1, s)
        return n

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if used(mid) <= shards else (mid + 1, high)
    return low


def plain(rows, shards):
    """{doc_id: (size, crc, shard, slot)} of rows (doc_id, text)."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    size = {t: len(t.encode()) + 16 for t in groups}
    weight = {t: size[t] * len(ids) for t, ids in groups.items()}
    heavy, left, alone = sorted(groups, key=lambda t: (-weight[t], min(groups[t]))), sum(weight.values()), []
    while len(alone) < min(shards - 1, len(heavy)) and weight[heavy[len(alone)]] * (shards - len(alone)) >= left:
        left -= weight[heavy[len(alone)]]
        alone.append(heavy[len(alone)])
    rest = sorted((t for t in groups if t not in alone), key=lambda t: min(groups[t]))
    filled = [[t] for t in alone]
    if rest:
        capacity, load = plain_capacity([weight[t] for t in rest], shards - len(alone)), 0
        filled.append([])
        for t in rest:
            if load + weight[t] > capacity:
                filled.append([])
                load = 0
            load += weight[t]
            filled[-1].append(t)
    found = {}
    for shard, texts in enumerate(filled):
        ids = [(i, t) for t in texts for i in sorted(groups[t])]
        found |= {i: (size[t], zlib.crc32(t.encode()), shard, slot) for slot, (i, t) in enumerate(ids)}
    return found


def result(df):
    return {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in df.collect()}


def check(spark, rows, shards, cells=1 << 16):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(sharding.assign(docs, shards, cells=cells)) == plain(rows, shards)


def test_small_tables(spark):
    words = ["a" * n for n in (3, 900, 40, 41, 7, 300, 301, 302, 5, 5000)]
    check(spark, [(i, words[i * 7 % 10]) for i in range(40)], 4)
    check(spark, [(i, "x" * (i * 37 % 113)) for i in range(300)] + [(1000 + i, "hot") for i in range(150)], 7, cells=8)
    check(spark, [(5, "é"), (6, None), (7, ""), (-3, None), (9, "long " * 50000)], 3)
    check(spark, [(1, "only")], 5)


def test_empty_and_odd_tables(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = spark.createDataFrame([(None, "b", 1, "s"), (None, "b", 2, "s"), (3, "a", 3, "s"), (3, "a", 3, "s"), (None, None, 4, "s")], "doc_id long, text string, n long, shard string")
    found = sharding.assign(odd, 2)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = found.collect()
    assert len(rows) == 5 and {r["law"] for r in rows} == {"bytes"} and all(r["grown_shard"] is None for r in rows)
    for shard, own in groupby(sorted(rows, key=lambda r: (r["shard"], r["slot"])), lambda r: r["shard"]):
        assert [r["slot"] for r in own] == list(range(sum(r["shard"] == shard for r in rows)))
    assert {r["shard"] for r in rows if r["size"] == 17 and r["doc_id"] == 3} == {0}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=80), st.integers(1, 9), st.integers(1, 12))
def test_search_sees_few_ends_and_finds_the_smallest_capacity(sizes, shards, cells):
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]

    def stretches(groups, width, near):
        inside = [e for e in ends if any(a <= e <= b for a, b in near)]
        return [(min(g), max(g), len(g)) for g in (list(v) for _, v in groupby(inside, lambda e: e // width))]

    kept, sharding.stretches = sharding.stretches, stretches
    try:
        found = sharding.cuts(None, ends[-1], shards, cells)
    finally:
        sharding.stretches = kept
    capacity, want, at = plain_capacity(sizes, shards), [], 0
    while at < ends[-1]:
        at = max(e for e in ends if e <= at + capacity)
        want.append(at)
    assert found == want


@pytest.mark.parametrize("name", ["op13_sharding"])
def test_real_documents(spark, sf, name):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(queries.queries()[name](spark, sf)) == plain(rows, 40)
