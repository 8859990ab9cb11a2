"""The class model against plain sums; it is a distribution and beats single counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import classlm


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def plain(rows, fold=7, out=2):
    rest = [zlib.crc32(("" if d is None else str(d)).encode()) % fold for d, _ in rows]
    c = Counter(w for (_, t), r in zip(rows, rest) if r != out for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return c, sorted(((d, r == out, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for (d, t), r in zip(rows, rest)), key=str)


def rare(model, counts, i, w):
    if not 1 <= i <= 1 + len(model.lexicon.suffixes):
        return 0.0
    return math.log10((counts[w] + 1) / (model.lexicon.group_tokens[i - 1] + model.lexicon.group_types[i - 1] + 1))


def by_hand(model, counts, text):
    """log10 probability of a text, one token after the other."""
    words = model.lexicon.words.decode().split("\n") if len(model.lexicon.counts) else []
    ids = {w: i + 2 + len(model.lexicon.suffixes) for i, w in enumerate(words[: model.lexicon.clustered])} | {"": classlm.END}
    before, total = classlm.END, 0.0
    for w in tokens(text):
        i = ids.get(w, model.lexicon.groups().get(w.encode()[-2:], 1))
        c = model.classes[i]
        total += model.transitions[before, c] + model.emissions[i] + rare(model, counts, i, w)
        before = c
    return total


def test_scores_against_plain_sums(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(900001, None), (900002, ""), (900003, "Nie-gesehen \t the"), (900003, "Nie-gesehen \t the"), (None, "the of"), (900004, "the x " * 50000)], "doc_id long, text string")
    docs = docs.unionByName(odd)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = classlm.predict(docs, share=1e-3, listed=1e-4, classes=6, rounds=2).collect()
    counts, want = plain(rows)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    train = docs.where(classlm.remainder(F.col("doc_id"), 7) != 2)
    model = classlm.learn(train, share=1e-3, listed=1e-4, classes=6, rounds=2)
    assert 0 < model.lexicon.clustered < len(model.lexicon.counts) < model.types
    scored = {(r.doc_id, r.n_tokens): r.score for r in classlm.score(docs, model).collect()}
    for d, t in rows[::9] + rows[-6:]:
        assert abs(scored[d, len(tokens(t))] - by_hand(model, counts, t)) < 1e-6 * len(tokens(t)) + 1e-6
    groups, words = model.lexicon.groups(), model.lexicon.words.decode().split("\n")[: model.lexicon.clustered]
    mass = np.zeros(7)  # over all tokens and one unknown word in each group, behind any class
    for w in counts:
        i = classlm.END if w == "" else words.index(w) + 2 + len(groups) if w in words else groups.get(w.encode()[-2:], 1)
        mass += 10 ** (model.transitions[:, model.classes[i]] + model.emissions[i] + rare(model, counts, i, w))
    for i in range(1, 2 + len(groups)):
        mass += 10 ** (model.transitions[:, model.classes[i]] + model.emissions[i] + rare(model, Counter(), i, ""))
    assert np.allclose(mass, 1)


def test_exchange_gains_and_beats_single_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = classlm.predict(docs, classes=8, rounds=4).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.95 * got[1] and got[0] > got[1] + 1000
    pairs = spark.createDataFrame([(1 + i, 1 + j, 50 if i % 2 != j % 2 else 1) for i in range(8) for j in range(8)], "a int, b int, n long")
    of, m = classlm.exchange(pairs, np.array([1.0] * 9), 2, 6)
    start = classlm.class_pairs(pairs, np.array([0, 1, 2, 1, 2, 2, 1, 2, 1]), 3)
    assert classlm.information(m) >= classlm.information(start) and len(set(of[1::2])) == 1 and len(set(of[2::2])) == 1


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert classlm.predict(empty).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = classlm.predict(spark.createDataFrame([(held, "a b", 1.0)], "doc_id long, text string, score double")).collect()
    assert len(r) == 1 and r[0].n_known == 0 and r[0].train_tokens == 0 and r[0].base_score == 0
