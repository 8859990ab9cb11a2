"""Benchmark passages against a plain semi-global alignment of every pair."""

import random

import numpy as np

from plumbline.llm import decontaminate as D


def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[k] = rng.choice("qxz")
        elif kind == 1:
            chars.insert(k, rng.choice("qxz"))
        else:
            del chars[k]
    return "".join(chars)


def test_every_pair_within_the_budget():
    rng = random.Random(8)
    words = ["ab", "the", "ion", "tion", "of", "erst", "nd"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 30)))) for i in range(25)] + [(90, "ab"), (91, None), (92, " \n")]
    docs = []
    for _ in range(120):
        item = rng.choice(items[:25])[1]
        body = edited(rng, item, rng.randint(0, len(item) // 8))
        docs.append(" ".join(rng.choices(words, k=rng.randint(0, 40))) + rng.choice([" ", ""]) + body + " " + " ".join(rng.choices(words, k=rng.randint(0, 40))))
    docs += ["", "ab", "AB\n", items[0][1]]
    found = D.index(items)
    whole = [D.normalize(d.encode()) for d in docs]
    rows = D.passages(found, whole)
    got = {(d, found.ids[i]) for d, i, *_ in rows}
    want = set()
    for d, text in enumerate(whole):
        for n, item in enumerate(found.items):
            if len(item) < D.Q and item == text or len(item) >= D.Q and fewest_edits(item, text) <= found.edits[n]:
                want.add((d, found.ids[n]))
    assert got == want and len(want) > 100
    for d, i, start, end, edits in rows:
        assert fewest_edits(found.items[i], whole[d][start:end]) == edits


def test_spans_and_odd_rows(spark):
    item = "Which of these  green\nrivers flows to the north of the old town, and why does it?"
    docs = [(1, "Before. " + item + " after"), (2, "É\t\tÉ " + item.upper().replace("OLD", "OLDE") + "!"), (3, None), (4, ""), (5, "clean text " * 30000), (None, item), (1, "Before. " + item + " after"), (6, item[:40])]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(10, item, 1), (10, item, 1), (11, None, 1), (12, "", 1)], "item_id long, text string, doc_id long")
    rows = D.find(df, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.edits) for r in rows), key=str) == [(1, 10, 0), (1, 10, 0), (2, 10, 1), (None, 10, 0)]
    assert all(docs[0][1][r.start : r.end] == item for r in rows if r.doc_id == 1)
    r = next(r for r in rows if r.doc_id == 2)
    assert docs[1][1][r.start : r.end].startswith("WHICH OF") and docs[1][1][r.start : r.end].endswith("DOES IT?")
    kept = D.keep_uncontaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert D.find(df, bench.limit(0)).collect() == [] and D.find(df.limit(0), bench).collect() == []
    assert D.keep_uncontaminated(df, bench.limit(0)).count() == 8
    halves = [f.ids for f in D.shards(spark.createDataFrame([(i, f"item number {i} of the benchmark") for i in range(40)], "item_id long, text string"), size=500)]
    assert len(halves) > 1 and sorted(i for h in halves for i in h) == list(range(40))


def test_exact_copies_in_real_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.find(docs, bench).collect()}
    items = [(r.item_id, D.normalize(r.text.encode())) for r in bench.collect()]
    exact = {(r.doc_id, i) for r in docs.select("doc_id", "text").collect() for i, t in items if t in D.normalize((r.text or "").encode())}
    assert exact and exact <= got and len(got) <= len(exact) * 1.2 + 2
    assert np.array(list(got)).shape[1] == 2
