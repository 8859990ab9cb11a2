"""Ranked search against a plain count of every score, and the parts of the index."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import lexical


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, queries, k=10):
    """{item: [(doc_id, score)]} of (doc_id, text) and (item, text); ids are distinct."""
    counts = {i: Counter(words_of(t)) for i, t in docs}
    n, total = sum(bool(c) for c in counts.values()), sum(c.total() for c in counts.values())
    df = Counter(w for c in counts.values() for w in c)
    found = {}
    for item, text in queries:
        scores = {}
        for i, c in counts.items():
            m = 25 + 75 * c.total() * n // max(total, 1)
            scores[i] = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words_of(text) if c[w])
        best = sorted(((i, s) for i, s in scores.items() if s > 0), key=lambda r: (-r[1], r[0]))[:k]
        if best:
            found[item] = best
    return found


def result(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["item_id"], r["rank"])):
        assert r["rank"] == len(found.setdefault(r["item_id"], [])) + 1
        found[r["item_id"]].append((r["doc_id"], r["score"]))
    return found


def test_many_shards_and_ties(spark):
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "STRASSE", "straße", "x9"]
    docs = [(1000 - i, " ".join(vocabulary[(i * i * (j + 3) + j * 7) % (5 + i % 60)] for j in range(i % 40))) for i in range(500)]
    docs += [(5000 + i, "alike words here") for i in range(40)] + [(9000, "long " * 30000 + "w7 tail"), (9001, None), (9002, "")]
    queries = [(i, " ".join(vocabulary[(i * 11 + j * j) % 64] for j in range(1 + i % 9))) for i in range(40)] + [(77, "alike here"), (78, None), (79, "?!"), (80, "absent"), (81, "w1 w1 w1 w2")]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(queries, "item_id long, text string")
    want = plain(docs, queries)
    assert result(lexical.search(a, b, shard_bytes=3000, pack=7)) == want
    assert result(lexical.search(a, b, k=3)) == plain(docs, queries, 3)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "cat dog"), (2, "cat"), (2, "cat"), (3, "dog dog"), (4, "bird"), (5, None)], "doc_id int, text string").withColumns({c: F.lit("x") for c in ("term", "shard", "item_id", "ids")})
    queries = spark.createDataFrame([("q", "cat"), ("q", "cat"), (None, "dog")], "item_id string, text string").withColumns({c: F.lit(1) for c in ("doc_id", "pack", "query")})
    rows = [tuple(r) for r in lexical.search(docs, queries).select("item_id", "rank", "doc_id").collect()]
    assert sorted(rows, key=repr) == sorted([("q", 1, 2), ("q", 2, 2), ("q", 3, None)] * 2 + [(None, 1, 3), (None, 2, None)], key=repr)
    assert lexical.search(docs.limit(0), queries).collect() == []
    assert lexical.search(docs, queries.limit(0)).collect() == []


def lists_of(documents):
    shard = lexical.Shard()
    for i, d in enumerate(documents):
        shard.add(i, " ".join(d).encode())
    terms = sum(map(len, documents))
    m = lexical.lengths_term(np.array([len(d) for d in documents], np.int64), len(documents), terms)
    names, (held, lasts, impacts, ends, data) = lexical.postings(shard.documents, shard.number, m)
    made = [lexical.List(*row, m) for row in zip(lasts.to_pylist(), impacts.to_pylist(), ends.to_pylist(), data.to_pylist())]
    return dict(zip(names, made)), m, held.to_pylist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=9), min_size=1, max_size=400), st.lists(st.tuples(st.sampled_from("abcdefgh"), st.integers(1, 50)), min_size=1, unique_by=lambda t: t[0]), st.integers(1, 6), st.integers(0, 10**6))
def test_walk_equals_all_scores(documents, query, k, floor):
    lists, m, held = lists_of(documents)
    for (name, found), n in zip(sorted(lists.items()), held):
        docs = [(i, d.count(name.decode())) for i, d in enumerate(documents) if name.decode() in d]
        got = [pair for b in range(len(found.lasts)) for pair in zip(*found.block(b))]
        assert got == [(i, int(lexical.impacts_of(np.array(c), m[i]))) for i, c in docs] and n == len(docs)
        assert [max(i for _, i in got[b * lexical.BLOCK : (b + 1) * lexical.BLOCK]) for b in range(len(found.impacts))] == found.impacts
    used = [(lists[t.encode()], w, t) for t, w in query if t.encode() in lists]
    scores = [(sum(w * int(lexical.impacts_of(np.array(d.count(t)), m[i])) for _, w, t in used if t in d), i) for i, d in enumerate(documents)]
    want = sorted(((s, i) for s, i in scores if s > 0 and s >= floor), key=lambda r: (-r[0], r[1]))[:k]
    got = lexical.walk([a for a, _, _ in used], [w for _, w, _ in used], k, floor)
    assert got == want


def test_blocks_that_cannot_pass_stay_compressed():
    documents = [["common", "top", "top", "top"] if 3000 <= i < 3020 else ["common"] * (1 + i % 3) + ["pad"] * 20 for i in range(20000)]
    lists, _, _ = lists_of(documents)
    common, top = lists[b"common"], lists[b"top"]
    assert len(common.lasts) == 157
    found = lexical.walk([common, top], [1, 1000], 10, 0)
    assert [d for _, d in found] == list(range(3000, 3010))
    after = common.blocks_read()
    assert after < 40  # the blocks up to the passage; those behind it are skipped unread
    lists, _, _ = lists_of(documents)
    floor = found[-1][0]
    assert lexical.walk([lists[b"common"], lists[b"top"]], [1, 1000], 10, floor) == found
    assert lists[b"common"].blocks_read() <= 2  # with the threshold known, nothing before it is read either
