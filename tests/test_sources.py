"""Appended batches: all or nothing, chained on, one writer; and files that are read whole or refused whole."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions.canon import GENESIS, link
from plumbline.operators import rows as ledger_rows
from plumbline.sources import appending, ledger, validated


def records(spark, rows):
    return spark.createDataFrame(rows, "ledger_id string, n long, raw string")


def test_batches_chain_on(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    first = records(spark, [("a", i, json.dumps({"k": i, "chain": "forged"})) for i in range(5)] + [("b", 1, '{"é": "ü", "ts": "mine"}')])
    got = {r.ledger_id: r for r in appending.append(spark, folder, first, now="2026-01-01T00:00:00Z").collect()}
    assert (got["a"].appended, got["a"].rows, got["a"].ok) == (5, 5, True) and got["b"].rows == 1
    second = records(spark, [("a", 7, '{"k": 7}'), ("a", 6, '{"k": 6}'), ("c", 0, "{}")]).repartition(3)
    again = {r.ledger_id: r for r in appending.append(spark, folder, second, stamp=False).collect()}
    assert set(again) == {"a", "c"} and (again["a"].appended, again["a"].rows, again["a"].ok) == (2, 7, True)
    lines = [r.raw for r in appending.read(spark, folder).where("ledger_id = 'a'").orderBy("line").collect()]
    before = GENESIS
    for raw, k in zip(lines, [0, 1, 2, 3, 4, 6, 7]):
        row = json.loads(raw)
        assert row["k"] == k and row["chain"] == link(before, row) and ("ts" in row) == (k < 5)
        before = row["chain"]
    assert again["a"].head == before
    assert json.loads(appending.read(spark, folder).where("ledger_id = 'b'").first().raw)["ts"] == "mine"
    assert appending.append(spark, folder, records(spark, [])).collect() == []


def test_one_bad_record_refuses_the_batch(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    appending.append(spark, folder, records(spark, [("a", 1, "{}")]))
    bad = [("a", 2, "{}"), ("a", 3, "[1]"), ("a", 4, "{torn"), ("a", 5, '{"x": "\\ud800"}'), (None, 6, "{}"), ("a", 7, None), ("a", 8, '{"k": 1, "k": 2}')]
    with pytest.raises(appending.Refused, match="6 records can't be rows"):
        appending.append(spark, folder, records(spark, bad))
    assert appending.read(spark, folder).count() == 1 and len(appending.batches(spark, folder)) == 1


def test_a_failed_task_leaves_no_row(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/store"
    appending.append(spark, folder, records(spark, [("a", 1, "{}")]))

    def broken(before, row):
        if row.get("k") == 90:
            raise RuntimeError("lost")
        return link(before, row)

    monkeypatch.setattr(appending, "link", broken)
    with pytest.raises(Exception, match="lost"):
        appending.append(spark, folder, records(spark, [("a", i, json.dumps({"k": i})) for i in range(100)] + [("z", 0, "{}")]))
    monkeypatch.setattr(appending, "link", link)
    assert [(r.ledger_id, r.line) for r in appending.read(spark, folder).collect()] == [("a", 1)]
    assert appending.append(spark, folder, records(spark, [("a", 1, "{}")])).first().rows == 2


def test_second_writer_is_refused(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/store"
    appending.append(spark, folder, records(spark, [("a", 1, "{}")]))
    seen = appending.batches
    monkeypatch.setattr(appending, "batches", lambda s, f: seen(s, f)[:0])  # as if it had looked before the first batch
    with pytest.raises(appending.Refused, match="another writer"):
        appending.append(spark, folder, records(spark, [("a", 1, '{"late": 1}')]))
    monkeypatch.setattr(appending, "batches", seen)
    assert appending.read(spark, folder).count() == 1


def test_torn_file_is_adopted(spark, tmp_path):
    (tmp_path / "old.jsonl").write_bytes(b'{"k": 1}\n\n[5]\n{"k": 2}\n{"k": ')
    folder = f"file://{tmp_path}/store"
    got = appending.append(spark, folder, appending.adopt(ledger.read_lines(spark, f"{tmp_path}/old.jsonl")), stamp=False).first()
    assert (got.rows, got.ok) == (2, True)
    assert ledger_rows.verify_lines(appending.read(spark, folder)).first().unreadable == 0


def lines_of(spark, texts, name="f"):
    return spark.createDataFrame([(name, i, t) for i, t in enumerate(texts, 1)], "ledger_id string, line long, raw string")


def problems(df):
    return {(r.ledger_id, r.line): r.problem for r in df.where("problem is not null").collect()}


def test_claims(spark):
    good = ['{"claim_id": "a", "claim": "x"}', "  ", '{"claim_id": "b", "claim": "", "near_match_id": "a"}', '{"claim_id": "c", "claim": "y", "near_match_id": null}']
    got = validated.whole(validated.claims(lines_of(spark, good)))
    assert [(r.claim_id, r.claim, r.near_match_id) for r in got.orderBy("line").collect()] == [("a", "x", None), ("b", "", "a"), ("c", "y", None)]
    bad = ["{", "[]", '{"claim_id": 5, "claim": "x"}', '{"claim_id": " ", "claim": "x"}', '{"claim_id": "d"}', '{"claim_id": "e", "claim": "x", "near_match_id": ""}', '{"claim_id": "f", "claim": "x", "near_match_id": 3}', '{"claim_id": "a", "claim": "again"}']
    both = lines_of(spark, good).unionAll(lines_of(spark, bad, "g"))
    found = problems(validated.claims(both))
    assert set(found) == {("g", i) for i in range(1, 9)}
    assert found["g", 1] == "invalid JSON" and found["g", 2] == "not a JSON object" and found["g", 8] == "claim_id appears twice"
    with pytest.raises(validated.BadRows, match="8 bad rows: g:1 invalid JSON") as e:
        validated.whole(validated.claims(both))
    assert e.value.problems.count() == 8
    with pytest.raises(ValueError, match="no rows"):
        validated.whole(validated.claims(lines_of(spark, [" "])))


def test_probes(spark):
    def probe(i, **scoring):
        return json.dumps({"id": i, "prompt": "p", "scoring": scoring}, ensure_ascii=False)

    good = [probe("z", type="exact_match", answer="  40"), probe(7, type="numeric_tolerance", answer="1e3", tolerance=0.5), probe("c", type="calibration", answerable=False), probe("d", type="calibration", answerable=True, answer="Paris")]
    got = validated.whole(validated.probes(lines_of(spark, good))).orderBy("id").collect()
    assert [(r.id, r.answer, r.answerable) for r in got] == [("7", "1e3", None), ("c", None, False), ("d", "Paris", True), ("z", "  40", None)] and got[0].tolerance == 0.5
    bad = ['{"id": 1, "prompt": "p"}', '{"id": 1, "scoring": {}}', probe("e"), probe("f", type="other"), probe("g", type="calibration"), probe("h", type="calibration", answerable=True), probe("i", type="exact_match", answer=4), probe("j", type="numeric_tolerance"), probe("k", type="numeric_tolerance", answer="forty"), probe("l", type="numeric_tolerance", answer=1, tolerance=True), probe("z", type="calibration", answerable=False)]
    found = problems(validated.probes(lines_of(spark, good).unionAll(lines_of(spark, bad, "g"))))
    assert set(found) == {("g", i) for i in range(1, 12)} and found["g", 11] == "id appears twice" and found["g", 4] == "unknown scoring type"


def test_roster(spark):
    ballots = spark.createDataFrame([("a.json", '{"v": 1}'), ("b.json", "{torn"), ("c d.json", "[1]")], "path string, text string")
    text = ["﻿scenario, trainee,ballot_path", "s1,Ann Lee,a.json", ",,", ',"Bo, Jr.","c d.json"']
    got = validated.whole(validated.roster(lines_of(spark, text), ballots, scenario="main", grader="g")).orderBy("line").collect()
    assert [(r.line, r.trainee, r.slug, r.ballot, r.scenario, r.grader, r.timestamp) for r in got] == [(2, "Ann Lee", "ann_lee", '{"v": 1}', "s1", "g", None), (4, "Bo, Jr.", "bo_jr", "[1]", "main", "g", None)]
    bad = ["trainee,ballot_path", "Ann,a.json", ",a.json", "Bo,", "Cy,none.json", "Di,b.json", "ANN!,a.json"]
    found = problems(validated.roster(lines_of(spark, bad), ballots, scenario="s"))
    assert {k[1]: v for k, v in found.items()} == {3: "trainee is empty", 4: "ballot_path is empty", 5: "ballot file not found", 6: "ballot is not readable JSON", 7: "slug collides with an earlier row"}
    assert set(problems(validated.roster(lines_of(spark, bad[:2]), ballots)).values()) == {"no scenario"}
    with pytest.raises(ValueError, match="must name ballot_path"):
        validated.roster(lines_of(spark, ["trainee,other"]), ballots)
    with pytest.raises(ValueError, match="nothing"):
        validated.roster(lines_of(spark, []), ballots)


def test_journal(spark):
    text = ['{"t": "2026", "verb": "check", "word": "good", "exit": 0, "target": null}', "torn {", "[1]", '{"verb": 5}', '  {"verb": "pin", "exit": true, "reason_word": "missing"}  ', ""]
    got = validated.journal(lines_of(spark, text)).orderBy("line").collect()
    assert [(r.line, r.verb, r.word, r.code, r.reason_word) for r in got] == [(1, "check", "good", 0, None), (5, "pin", None, None, "missing")]


def test_odd_columns(spark):
    df = records(spark, [("a", 1, "{}")]).withColumns({c: F.lit(1) for c in ("line", "body", "head", "rows", "problem")})
    assert appending.stamped(df, None).first().problem is None
