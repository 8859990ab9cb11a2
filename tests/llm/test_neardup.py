"""Near-duplicates by Jaccard similarity against a plain all-pairs version."""

import random
import re

from pyspark.sql import types as T

import corpus_pipeline as P
import numpy as np

from plumbline.llm import neardup

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def plain_kept(rows):
    """The smallest id of each group, all pairs compared."""
    found = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(found):
        for j in range(i):
            both = len(a & found[j])
            if 5 * both >= 4 * (len(a) + len(found[j]) - both):
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def edited(seed=5):
    """Texts with copies at all distances about the threshold, chains of copies, a common line, short and empty ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    line = " ".join(word() for _ in range(12))
    out = []
    for k in range(30):
        words = [word() for _ in range(rng.choice([6, 20, 60, 150]))] + (line.split() if k % 3 else [])
        for _ in range(rng.choice([1, 4, 8])):
            out.append(" ".join(words))
            if rng.random() < 0.5:
                words = list(words)  # a chain: the next is a copy of this copy
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
            if rng.random() < 0.5:
                words = copy
    out += ["", None, "  ", "one two", "One  two", "one two three", line, line]
    rng.shuffle(out)
    return list(enumerate(out))


def test_stage_keeps_what_all_pairs_keep(spark):
    rows = edited()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    want = plain_kept(rows)
    assert 20 < len(want) < len(rows) - 60
    for sample in (20_000, 10):  # the sample bears on the cost alone
        neardup.SAMPLE = sample
        kept = P.drop_near_duplicates(spark, docs, "")
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    neardup.SAMPLE = 20_000
    assert P.drop_near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").collect() == []


def test_edited_copy_goes(spark):
    words = [f"w{i}" for i in range(200)]
    copy = [*words[:100], "other", *words[101:]]
    docs = spark.createDataFrame([(1, " ".join(words), "a"), (2, " ".join(copy), "b"), (3, " ".join(words[:120]), "c")], SCHEMA)
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, "").select("doc_id").collect()) == plain_kept(rows)


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(11)
    for _ in range(50):
        a, b = (np.unique(rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 3000))) for _ in range(2))
        b = np.unique(np.concatenate([b[: rng.integers(0, 50)], a[rng.integers(0, 5) :]]))
        bits = np.frombuffer(neardup.parity(a), np.uint64) ^ np.frombuffer(neardup.parity(b), np.uint64)
        assert sum(int(x).bit_count() for x in bits) <= len(np.setxor1d(a, b))
