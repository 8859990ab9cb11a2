"""Exported trails against plain Python, their gaps, and every way to break them."""

import hashlib
import json

from pyspark.sql import functions as F

from plumbline.functions.canon import digest, jcs
from plumbline.operators import trail

ROWS = [
    {"ts": "t1", "agent": "A b", "evt": "tool_call", "tool": "x", "args_digest": "d", "status": "ok", "seq": 1, "seam": "stdio", "seam_impl": "p", "chain": "c1"},
    {"event": "decision", "inputs": {"b": 1, "a": [1.5]}, "outputs": None, "system_id": "s", "session": "S", "status": "odd"},
    {"evt": "session_end", "action": "blocked", "mandate_mode": "enforce", "seq": 2**60, "record_error": True, "agent": "", "seam": "http"},
    {"evt": "other", "ts": 5, "seq": True, "tool": "only"},
]


def lines(spark, texts):
    return spark.createDataFrame([("l", i, t) for i, t in enumerate(texts, 1)], "ledger_id string, line long, raw string").repartition(2)


def test_export(spark):
    texts = [json.dumps(r) for r in ROWS] + ["[1]", "{torn", "", '{"ts": "\\ud800"}']
    made = trail.records(lines(spark, texts)).cache()
    got = {r.line: (json.loads(r.record) if r.record else None, r.refused) for r in made.collect()}
    assert got[1] == ({"timestamp": "t1", "agent_id": "urn:agent:A%20b", "action_type": "tool_call", "action_detail": {"tool_name": "x", "parameters_hash": "d"}, "outcome": "success", "sequence_number": 1, "recording_component": "proxy (stdio, p)", "chain": "c1", "source_line": 1}, [])
    assert got[2] == ({"agent_id": "urn:agent:s", "session_id": "S", "action_type": "decision", "input_hash": digest({"a": [1.5], "b": 1}), "output_hash": digest(None), "source_line": 2}, [])
    assert got[3] == ({"action_type": "error", "outcome": "denied", "recording_component": "proxy (http)", "source_line": 3}, ["sequence_number"])
    assert got[4] == ({"action_detail": {"tool_name": "only"}, "source_line": 4}, []) and got[5][0] is got[6][0] is None and 7 not in got
    assert got[8] == ({"source_line": 8}, ["timestamp"])
    out = trail.exported(made).orderBy("line").collect()
    before = None
    for r in out:
        assert r.raw == jcs({**got[r.line][0], "prev_hash": before})
        before = hashlib.sha256(r.raw.encode()).hexdigest()
    assert [r.line for r in out] == [1, 2, 3, 4, 8]
    gaps = {(r.field, r.why): (r.n, r.first) for r in trail.gaps(made).collect()}
    assert gaps["timestamp", "not_held"] == (3, 2) and gaps["timestamp", "not_exact"] == (1, 8) and gaps[None, "no_object"] == (2, 5) and gaps["sequence_number", "not_exact"] == (1, 3) and ("chain", "not_held") not in gaps


def test_verify(spark):
    raws = [r.raw for r in trail.exported(trail.records(lines(spark, [json.dumps({"ts": f"é{i}", "seq": i}) for i in range(30)]))).orderBy("line").collect()]

    def check(texts):
        df = spark.createDataFrame([("l", i, t) for i, t in enumerate(texts, 1)], "ledger_id string, n long, raw string").withColumn("form", F.lit(1))
        return tuple(trail.verified(df.repartition(3)).first())[1:]

    assert check(raws) == (30, None, None)
    assert check(raws[:10] + raws[11:]) == (29, 11, "broken") and check(raws[1:]) == (29, 1, "broken")
    assert check(raws[:5] + [raws[5].replace('"sequence_number":5', '"sequence_number":6')] + raws[6:]) == (30, 7, "broken")
    assert check(raws[:5] + [raws[5].replace(",", ", ")] + raws[6:]) == (30, 6, "not_canonical")
    assert check(raws[:2] + ["[]"] + raws[3:]) == (30, 3, "not_object") and check([None]) == (1, 1, "not_object")
    assert check([jcs({"a": 1})]) == (1, 1, "broken")
    assert trail.verified(spark.createDataFrame([], "ledger_id string, n long, raw string")).collect() == []
