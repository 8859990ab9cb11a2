"""Tokens, packing and length histograms against plain versions."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from plumbline.llm import lengths, packing, tokens

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.StringType())])


def plain():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_ids_are_those_of_the_other_library():
    rng, other = random.Random(4), plain()
    pool = ["the ", " a", "é", "ß", "\n", "\n\n ", "  ", "\t", "'s", "'LL", "12", "½", "中文", "🙂", " ", " ", "x" * 50, "!?", "<|endoftext|>", "\r\n", "Ü", "\x00", "\x85", "́"]
    made = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(3000)]
    for t in made:
        assert tokens.encode(t).tolist() == other.encode(t, add_special_tokens=False).ids, repr(t)


def test_parts_change_no_id():
    rng = random.Random(5)
    text = "".join(rng.choices(["word ", "an ", " other", "\n", "x. ", "é ", "1 a "], k=20000))
    assert "".join(tokens.parts(text, 100)) == text
    apart = [i for p in tokens.parts(text, 100) for i in tokens.encoding().encode_ordinary(p)]
    assert apart == tokens.encoding().encode_ordinary(text)


def check(rows, got, capacity=1024):
    other = plain()
    want = []
    for d, t, *_ in rows:
        ids = np.array([*other.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
        edges = [0, *range(first, len(ids) + 1, capacity)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    return len(bins), -(-total // capacity)


def test_pack_real_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bins, least = check(docs.select("doc_id", "text").collect(), packing.pack(docs).collect())
    assert bins <= 1.01 * least + 1


def test_pack_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "one two", None), (3, "word " * 5000, "c"), (4, "x y " * 511 + "z", "d"), (5, "🙂" * 3000, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    check(rows, packing.pack(df).collect())
    assert packing.pack(df.limit(0)).collect() == []


def test_plan_matches_one_bin_at_a_time():
    rng = np.random.default_rng(6)
    for capacity in (10, 37, 64):
        counts = np.zeros(capacity + 1, np.int64)
        counts[1:] = rng.integers(0, 9, capacity) * rng.integers(0, 2, capacity)
        left, bins = counts.copy(), 0
        while left.any():
            for n, k in packing.fill(left, capacity).items():
                left[n] -= k
            bins += 1
        runs, found = packing.plan(counts, capacity)
        assert found == bins
        load = np.zeros(bins, int)
        for n, r in runs.items():
            for (a, b, _), nxt in zip(r, [*(x[0] for x in r[1:]), int(counts[n])]):
                load[b : b + nxt - a] += n
        assert load.max() <= capacity and load.sum() == (counts * np.arange(capacity + 1)).sum()


def test_two_fit_beats_plain_greedy():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]  # 6+3 leaves 1; 6+2+2 leaves none
    assert dict(packing.fill(counts, 10)) == {6: 1, 2: 2}


def test_token_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (None, "word " * 4000)], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), odd):
        n = [len(tokens.encode(r.text or "")) for r in df.collect()]
        sums = lengths.token_counts(df)
        rows = {r.length: r for r in sums.collect()}
        assert set(rows) == set(n)
        for limit, r in rows.items():
            assert r.n_docs == n.count(limit) and r.docs_above == sum(x > limit for x in n) and r.tokens_above == sum(x for x in n if x > limit)
            assert r.tokens_kept == sum(min(x, limit) for x in n) and r.tokens_total == sum(n) and r.docs_total == len(n)
            assert r.tokens_lost == r.tokens_total - r.tokens_kept and abs(r.quantile - sum(x <= limit for x in n) / len(n)) < 1e-12
    for limit in (0, 1, 777, 10**6):
        assert tuple(lengths.at_limit(sums, limit).first()) == (sum(min(x, limit) for x in n), sum(x > limit for x in n))
    assert lengths.length_quantile(sums, 0.5).first()[0] == 0
    assert lengths.token_counts(docs.limit(0)).collect() == []
