"""Seals: what is probed, what is refused, and every way to alter a snapshot."""

import json

import pytest

from plumbline.functions.canon import canonical, digest
from plumbline.operators import snapshots


def states(spark, *raws):
    return [r.state for r in snapshots.check(spark.createDataFrame(list(enumerate(raws)), "id int, raw string")).orderBy("id").collect()]


def test_seals(spark):
    manifest = {"anchors": ["one", "two", "one"], "facts": {"b": 1, "a": [2]}, "none": [], "é": None}
    rows = [(1, "l", json.dumps(manifest)), (2, None, "{}"), (3, "l", "[1]"), (4, "l", '{"a": 1, "a": 2}'), (5, "l", '{"a": NaN}'), (6, "l", None), (7, "l", '{"a": []}')]
    df = spark.createDataFrame(rows, "id int, label string, manifest string").selectExpr("*", "1 AS raw", "2 AS problem")
    got = {r.id: r for r in snapshots.sealed(df, "t").collect()}
    assert [got[i].problem is None for i in range(1, 8)] == [True] + [False] * 6
    s = json.loads(got[1].raw)
    assert len(s["probes"]) == 4 and s["manifest_digest"] == digest(manifest) and {p["scoring"]["answer"] for p in s["probes"]} == {"one", "two", '{"a":[2],"b":1}', "null"}
    more = json.loads(snapshots.sealed(spark.createDataFrame([(1, "l", json.dumps(manifest | {"anchors": ["new", "two"]}))], "id int, label string, manifest string"), "t").first().raw)
    assert len({p["id"] for p in s["probes"]} & {p["id"] for p in more["probes"]}) == 3  # the rest keeps its ids
    by_place = json.loads(snapshots.sealed(df, "t", "index").where("id = 1").first().raw)
    assert {p["id"] for p in by_place["probes"]} == {"anchors:0", "anchors:1", "anchors:2", "facts:0", "é:0"}
    with pytest.raises(ValueError):
        snapshots.sealed(df, "t", "other")

    def altered(**parts):
        return canonical(s | parts)

    swapped = {"manifest": {"x": 1}, "manifest_digest": digest({"x": 1})}
    cases = [
        (got[1].raw, "good"), (altered(probes=s["probes"][::-1]), "good"), (canonical(by_place), "good"), (altered(manifest={"x": 1}), "manifest_altered"), (altered(**swapped), "probes_not_of_manifest"),
        (altered(probes=s["probes"][1:]), "probes_altered"), (altered(label="m"), "seal_altered"), (altered(created_at="u"), "seal_altered"), (altered(id_scheme="index"), "probes_not_of_manifest"),
        (altered(id_scheme="none"), "malformed"), (altered(probes=[]), "malformed"), (altered(probes=[{"id": 1}]), "malformed"), (altered(manifest=[1]), "malformed"), (canonical({k: v for k, v in s.items() if k != "digest"}), "malformed"),
        (altered(schema="other"), "other_schema"), ("[]", "other_schema"), ("{torn", "unreadable"), (None, "unreadable"), ('{"schema": "a", "schema": "b"}', "unreadable"),
    ]
    assert states(spark, *[c for c, _ in cases]) == [w for _, w in cases]
    assert states(spark) == []
