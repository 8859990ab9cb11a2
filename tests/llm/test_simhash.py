"""SimHash near-duplicates against a plain all-pairs version."""

import re

import pytest
import xxhash
from pyspark.sql import types as T

from plumbline.llm import simhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows, radius=2):
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def test_real_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (None, "one"), (6, "a b"), (7, "É x y z w"), (8, base), (8, base), (9, base + " tail"), (10, "w " * 200000), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = simhash.near_duplicates(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_chains_and_radii(spark, radius):
    fps = [0, 1, 3, 7, 15, 1 << 63, (1 << 63) | (1 << 31), (1 << 32) | (1 << 31), 0xFF << 20, (0xFF << 20) ^ (1 << 40) ^ (1 << 3)]
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    want = {tuple(sorted((simhash._signed(a), simhash._signed(b)))) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= radius}
    assert {tuple(r) for r in simhash.links(df, radius).collect()} == want
