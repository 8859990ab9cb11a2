"""Divergences against a plain count, on small and odd tables."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import divergence


def plain(rows, least=3, ranks=200):
    """Rows (lang, source, part, item, value, rank) of rows (text, lang, source)."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, a, b in rows]
    groups, found = defaultdict(Counter), []
    holding = defaultdict(Counter)
    for lang, source, words in docs:
        groups[lang, source].update(words)
        holding[lang].update(set(words))
    for lang in holding:
        kept = [t for t, n in holding[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (a, s), c in groups.items() if a == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def weigh(counts):
            total = sum(counts.values()) + len(kept)
            return {t: 1 + 10**9 * (n + 1) // total for t, n in counts.items()}

        p, q = {s: weigh(c) for s, c in own.items()}, weigh(whole)
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in own if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                found += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(items)]
    return sorted(found)


def check(spark, rows, least=3, ranks=200, **more):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = divergence.audit(docs.repartition(3), least_docs=least, ranks=ranks, **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, ranks)


def test_small_tables(spark):
    words = "alpha Beta gamma beta écrit ÉCRIT x9y z-z delta".split()
    rows = [(" ".join(words[(i * 5 + j * j) % 9] for j in range(i % 17)), "ab"[i % 2], f"s{i * 7 % 5}") for i in range(60)]
    rows += [(None, "a", "s1"), ("", "a", "empty"), ("1 2 3", "c", None), (None, None, None), ("beta " * 3000, "b", "s2"), ("only here", "d", "x"), ("twice", "c", "y")]
    check(spark, rows, width=4, wave=2)
    check(spark, rows, least=1, ranks=3)


def test_empty_and_odd_tables(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    rows = [("one two", "a", "s"), ("one two", "a", "s"), ("two one", "a", "t")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "n", "slice", "at", "item", "total")})
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == plain(rows)


def test_rounds_meet_every_pair_once(spark):
    for peers in range(1, 12):
        last = peers + peers % 2 - 1
        rows = spark.range(peers).select(F.col("id").alias("at"), F.lit(peers).cast("long").alias("peers"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last - 1).cast("long"))).alias("turn"))
        met = rows.withColumn("other", divergence.partner(F.col("at"), F.col("turn"))).where("other < peers").collect()
        assert all(r["at"] != r["other"] for r in met)
        assert Counter(frozenset((r["at"], r["other"])) for r in met) == Counter({frozenset(p): 2 for p in combinations(range(peers), 2)})
        assert len({(r["at"], r["turn"]) for r in met}) == len(met)


@given(st.lists(st.integers(0, 10**12), max_size=9), st.integers(0, 10**13))
def test_weights_are_exact(counts, more):
    total = sum(counts) + len(counts) + more
    assert divergence.weights(np.array(counts, np.int64), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


@given(st.lists(st.integers(0, 2**62)))
def test_packed_numbers_come_back(values):
    packed = divergence._packed(np.array(values, np.int64))
    assert divergence._unpacked(packed, len(values)).tolist() == values


def test_residents_are_not_dealt_again(spark):
    rows = spark.createDataFrame([("a", 0, "s", 0, 2, 1, 1, 1, 0, None, None), ("a", 0, "t", 1, 2, 1, 1, 1, 0, None, None)], "lang string, slice long, source string, at long, peers long, total long, kept long, width long, own long, ids binary, counts binary")
    resident = divergence.settle(rows)
    plan = divergence.rotate(resident, 0, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("InMemoryTableScan")], plan
    resident.unpersist()
