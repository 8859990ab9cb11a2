"""Alignment against a plain version on small random sessions; number forms of canonical JSON."""

import random
from collections import defaultdict

import pytest

from plumbline.functions import canon
from plumbline.operators import receipts, tapes


def longest(values):
    best = []
    for i, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(i) if values[j] < v), default=0))
    return max(best, default=0)


def test_alignment(spark):
    rng = random.Random(6)
    a, t = [], []
    for s in range(60):
        calls = [(rng.choice("pqr"), rng.choice(["1", "2", "3", None])) for _ in range(rng.randint(0, 12))]
        other = [(q, r if rng.random() < 0.9 else rng.choice(["9", None])) for q, r in calls if rng.random() < 0.9]
        for _ in range(rng.randint(0, 2)):
            if other:
                other.insert(rng.randrange(len(other)), other.pop(rng.randrange(len(other))))
        a += [(str(s), i, q, r) for i, (q, r) in enumerate(calls, 1)]
        t += [(str(s), i, q, r) for i, (q, r) in enumerate(other, 1)]
    schema = "session string, idx long, req string, resp string"
    got = defaultdict(list)
    for r in tapes.align(spark.createDataFrame(a, schema), spark.createDataFrame(t, schema)).collect():
        got[r.session].append((r.verdict, r.at, r.side))
    for s in range(60):
        mine, other = ([x for x in side if x[0] == str(s)] for side in (a, t))
        waiting = defaultdict(list)
        for _, i, q, r in other:
            waiting[q, r].append(i)
        pairs, left = [], []
        for _, i, q, r in mine:
            if waiting[q, r]:
                pairs.append((i, waiting[q, r].pop(0)))
            else:
                left.append((i, q, r))
        spare = defaultdict(list)
        for _, i, q, r in other:
            if i in waiting[q, r]:
                spare[q].append((i, r))
        want = []
        for i, q, r in left:
            if spare[q]:
                j, r2 = spare[q].pop(0)
                want.append(("ALTERED", i, None) if r and r2 else ("MISSING", i, "tool" if r2 is None else "agent"))
            else:
                want.append(("MISSING", i, "tool"))
        want += [("MISSING", j, "agent") for rest in spare.values() for j, _ in rest]
        order = [j for _, j in pairs]
        n_moved = len(order) - longest(order)
        own = sorted(got[str(s)], key=str)
        for f in want:
            own.remove(f)
        gone = {i for _, i, _ in own}
        assert len(own) == n_moved and all(v == "ALTERED" for v, _, _ in own)
        assert [j for i, j in pairs if i not in gone] == sorted(j for i, j in pairs if i not in gone)


def test_canonical_numbers_and_strings():
    forms = {1.0: "1", 1e21: "1e+21", 1e20: "100000000000000000000", 1e-7: "1e-7", 1e-6: "0.000001", -0.0: "0", 1.5: "1.5", 123456.789: "123456.789", -2.5e-9: "-2.5e-9", 5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", 333333333.33333329: "333333333.3333333"}
    for value, text in forms.items():
        assert canon.jcs(value) == text
    assert canon.jcs({"b": [1, None, True], "a": "é\n", "€": 1}) == '{"a":"é\\n","b":[1,null,true],"€":1}'
    for bad in ("\ud800", {"\ud800": 1}, float("nan"), 2**60):
        try:
            canon.jcs(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_a_third_tape_is_refused(spark):
    pins = spark.createDataFrame([("p", "agent", None), ("q", None, "n"), ("r", None, None)], "pin string, side string, ns string")
    tapes = [("t1", "agent", "n"), ("t2", "tool", "m"), ("t3", "tool", "n")]
    got = receipts.route_pins(pins, spark.createDataFrame(tapes[:2], "tape string, side string, ns string"))
    assert sorted(map(tuple, got.collect())) == [("p", "t1"), ("q", "t1"), ("r", "t1"), ("r", "t2")]
    with pytest.raises(ValueError, match="at most 2"):
        receipts.route_pins(pins, spark.createDataFrame(tapes, "tape string, side string, ns string"))
    assert receipts.route_pins(pins, spark.createDataFrame([], "tape string, side string, ns string")).collect() == []
