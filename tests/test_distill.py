"""Distilled texts against plain Python: what is kept, what each receipt says, and what is refused."""

import hashlib
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.canon import digest
from plumbline.operators import distill
from plumbline.plans import distilling

RAW = "sha256:raw-bytes:v1:"


def raw_digest(text):
    return RAW + hashlib.sha256(text.encode()).hexdigest()


def run(spark, texts, tokens, query=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    return [r.asDict(recursive=True) for r in distill.distill(rows, tokens, query).orderBy("id").collect()]


def plain_prose(text, budget, query):
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    if not parts or len(text) <= budget:
        return text, []
    asked = set(re.findall("[a-z0-9]+", (query or "").lower()))
    weight = {i: max(1 / (i + 1), 1 / (len(parts) - i)) + 2 * len(asked & set(re.findall("[a-z0-9]+", p.lower()))) for i, p in enumerate(parts)}
    chosen, used = set(), 0
    for i in sorted(weight, key=lambda i: (-weight[i], i)):
        if not chosen or (used < budget and used + len(parts[i]) + 1 <= budget):
            chosen.add(i)
            used += len(parts[i]) + 1
    said = ""
    for i in sorted(chosen):
        said += ("" if not said else " " if i - 1 in chosen else " [...] ") + parts[i]
    return said, [p for i, p in enumerate(parts) if i not in chosen]


@pytest.mark.parametrize("query", [None, "beta 7 gamma"])
def test_prose(spark, query):
    words = "alpha Beta gamma delta seven 7 eight".split()
    texts = [" ".join(f"{words[(i * j + k) % 7]} {'x' * ((i + j * k) % 29)}{'.!?'[j % 3]}" for j in range(k)) for i in range(6) for k in (1, 3, 12, 40)]
    texts += ["One long sentence that is over any budget by itself " * 20, "a. " * 300, " . ", "no end mark at all", "é. ü! ñ? " * 50]
    for r, text in zip(run(spark, texts, 30, query), texts):
        said, gone = plain_prose(text, 120, query)
        assert r["strategy"] == "text" and r["content"] == said
        drops = r["receipt"]["drops"]
        assert [(d["digest"], d["dropped_bytes"], d["dropped_count"]) for d in drops] == ([(raw_digest(" ".join(gone)), len(" ".join(gone).encode()), len(gone))] if gone else [])
        assert r["receipt"]["full"] == {"digest": raw_digest(text), "bytes": len(text.encode())} and r["receipt"]["distilled"]["digest"] == raw_digest(said)


def test_tables(spark):
    head = "a,b,c"
    rows = [f"{i},{'v' * (i % 7)},{i * i}" for i in range(100)]
    ruled = "x|y\n--|--\n" + "\n".join(f"{i}|{i}" for i in range(60))
    texts = ["\n\n" + "\n".join([head, *rows]) + "\n", "\n".join([head, *rows[:40]]), ruled, ""]
    got = run(spark, texts, 10)
    assert [r["strategy"] for r in got] == ["table", "table", "table", "text"]
    assert got[0]["content"] == "\n\n" + "\n".join([head, rows[0], rows[1], "...+96 rows dropped...", rows[98], rows[99]]) + "\n"
    assert got[0]["receipt"]["drops"] == [{"kind": "rows_dropped", "path": "$", "digest": raw_digest("\n".join(rows[2:98])), "dropped_bytes": len("\n".join(rows[2:98])), "dropped_count": 96}]
    assert got[1]["content"] == texts[1] and got[1]["receipt"]["truncated"] is False
    lines = got[2]["content"].split("\n")
    assert lines[:2] == ["x|y", "--|--"] and sum("dropped" in x for x in lines) == 1


def resolve(value, path):
    for key, index in re.findall(r"\.?([^.\[\]]+)|\[(\d+)\]", path.removeprefix("$")):
        value = value[key] if key else value[int(index)]
    return value


def caps_of(budget, value):
    """The caps of each round up to the one that fits."""
    return [(max(20, 300 >> i), max(2, 20 >> i), max(4, 200 >> i)) for i in range(12)]


JSONS = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 10**6) | st.text("abcdé", max_size=700),
    lambda inner: st.lists(inner, max_size=50) | st.dictionaries(st.text("abcdefgh", min_size=1, max_size=3), inner, max_size=30),
    max_leaves=60,
)


@settings(max_examples=150, deadline=None)
@given(JSONS, st.integers(1, 400))
def test_every_cut_of_a_tree_is_named(value, tokens):
    if not isinstance(value, (dict, list)):
        return
    kept, drops = distill._tree(value, 4 * tokens)
    sizes, size = [], len(json.dumps(kept, separators=(",", ":"), ensure_ascii=False))
    for text_cap, list_cap, key_cap in caps_of(4 * tokens, value):
        part = distill._capped(value, (text_cap, list_cap, key_cap), "", [])
        sizes.append(len(json.dumps(part, separators=(",", ":"), ensure_ascii=False)))
        if sizes[-1] <= 4 * tokens:
            break
    assert size == min(sizes)
    assert (kept == value) == (not drops)
    for d in drops:
        whole = resolve(value, d["path"])
        if d["kind"] == "string_truncated":
            gone = whole[len(whole) - d["dropped_count"] :]
            assert d["digest"] == raw_digest(gone) and d["dropped_bytes"] == len(gone.encode())
            continue
        items = list(whole.items()) if isinstance(whole, dict) else whole
        n, head = d["dropped_count"], -(-(len(items) - d["dropped_count"]) // 2)
        gone = items[head : head + n]
        gone = dict(gone) if isinstance(whole, dict) else gone
        assert d["digest"] == digest(gone) and d["dropped_bytes"] == len(json.dumps(gone, separators=(",", ":"), ensure_ascii=False).encode())


def test_json(spark):
    tree = {"id": 1, "log": list(range(50)), "note": "n" * 400, "wide": {f"k{i}": i for i in range(300)}, "deep": {"list": [{"s": "é" * 310}]}}
    rows = [{"a": i, "b": "x" * 20} for i in range(100)]
    texts = [json.dumps(tree), json.dumps(rows), json.dumps([[1, 2]] * 9), '{"n": NaN}', '["\\ud800", 1]', "[" * 100000, "[1, 2", '{"a": 1}', None]
    got = run(spark, texts, 1200)
    assert [r["strategy"] for r in got] == ["json", "rows", "rows", "refused", "refused", "refused", "text", "json", None]
    kept = json.loads(got[0]["content"])
    assert [d["path"] for d in got[0]["receipt"]["drops"]] == ["log", "note", "wide", "deep.list[0].s"]
    assert kept["log"][:10] == list(range(10)) and kept["log"][10] == "...+30 more items" and kept["log"][11:] == list(range(40, 50))
    assert kept["wide"]["__distilled_dropped_keys__"] == 100 and kept["note"] == "n" * 300 + "...+100 more chars"
    assert got[0]["receipt"]["distilled"]["digest"] == digest(kept)
    table = json.loads(got[1]["content"])
    assert table[20] == {"__distilled_dropped_rows__": 60} and len(table) == 41 and got[1]["receipt"]["drops"][0]["digest"] == digest(rows[20:80])
    assert got[7]["content"] == '{"a":1}' and got[3]["receipt"] is None and got[8]["content"] is None


def test_receipts(spark):
    good = {"schema": distill.SCHEMA, "full": {"digest": raw_digest("a"), "bytes": 1}, "distilled": {"digest": raw_digest(""), "bytes": 0}, "drops": [{"digest": raw_digest("a"), "dropped_bytes": 1, "dropped_count": 1}], "truncated": True}
    drop = good["drops"][0]
    cases = [
        ("consistent", good), ("consistent", good | {"drops": [], "truncated": False}), ("unknown_schema", good | {"schema": "other"}), ("unknown_schema", {}), ("malformed", good | {"full": "x"}),
        ("malformed", {k: v for k, v in good.items() if k != "drops"}), ("malformed", good | {"drops": ["x"]}), ("inconsistent", good | {"truncated": False}),
        ("inconsistent", good | {"drops": [drop | {"dropped_count": -1}]}), ("inconsistent", good | {"drops": [drop | {"dropped_count": True}]}), ("inconsistent", good | {"drops": [{"digest": drop["digest"], "dropped_bytes": 1}]}),
        ("inconsistent", good | {"full": {"digest": "sha256:raw-bytes:v1:0xff", "bytes": 1}}), ("inconsistent", good | {"full": {"digest": RAW + "A" * 64, "bytes": 1}}),
    ]
    raw = [(i, json.dumps(c)) for i, (_, c) in enumerate(cases)] + [(100, None), (101, "[1]"), (102, "{torn"), (103, "5")]
    got = {r.id: r.s for r in spark.createDataFrame(raw, "id int, raw string").select("id", distill.receipt_state(F.col("raw")).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for w, _ in cases]
    assert [got[i] for i in (100, 101, 102, 103)] == ["malformed"] * 4


def test_real_inputs_reconcile(spark, sf):
    rows = [r.asDict(recursive=True) for r in distilling.ds_distill(spark, sf).collect()]
    assert {r["strategy"] for r in rows} >= {"json", "rows", "table", "text"} and all(r["state"] == "consistent" for r in rows)
