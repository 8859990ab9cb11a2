"""Readings that may be appended, and looked-up citations, against plain Python."""

import hashlib
import json
import random
import re

from plumbline.operators import lookups, readings
from plumbline.sources import appending


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def criteria(spark, rows):
    return readings.build_criteria(spark.createDataFrame(rows, "ledger_id string, n long, text string, supersedes string"), "t")


SCHEMA = "ledger_id string, n long, claim_id string, claim_text string, claim_sha256 string, criterion_sha256 string, reader struct<id:string,provider:string,model:string,endpoint_host:string>, reading string, near_match_id string, rationale string, prompt_sha256 string"


def reading(n, criterion, ledger="a", **more):
    row = {"claim_id": "c", "claim_text": "x", "claim_sha256": None, "reader": (" AnnＡ ", "p", None, None), "reading": "yes", "near_match_id": None, "rationale": None, "prompt_sha256": None} | more
    return (ledger, n, row["claim_id"], row["claim_text"], row["claim_sha256"], criterion, row["reader"], row["reading"], row["near_match_id"], row["rationale"], row["prompt_sha256"])


def test_rows_are_built(spark):
    bad = [reading(1, sha("k"), reading="maybe"), reading(2, sha("k"), claim_id=" "), reading(3, sha("k"), claim_text=None), reading(4, sha("k"), claim_sha256=sha("y")), reading(5, "short"), reading(6, sha("k"), reader=("", "p", None, None)), reading(7, sha("k"), near_match_id=""), reading(8, sha("k"), prompt_sha256="F" * 64)]
    good = [reading(10, sha("k")), reading(11, sha("k"), claim_text=None, claim_sha256=sha("y"), near_match_id="m", rationale="why")]
    made = readings.build_readings(spark.createDataFrame(bad + good, SCHEMA), "t").orderBy("n").collect()
    assert [bool(r.problem) for r in made] == [True] * 8 + [False] * 2 and len({r.problem for r in made[:8]}) == 7
    first, second = json.loads(made[8].raw), json.loads(made[9].raw)
    assert first == {"evt": "reading", "format": "reading/1", "claim_id": "c", "claim_sha256": sha("x"), "criterion_sha256": sha("k"), "reader": {"id": "anna", "provider": "p", "model": None, "endpoint_host": None}, "reading": "yes", "rationale_sha256": None, "prompt_sha256": None, "ts": "t"}
    assert second["near_match_id"] == "m" and second["rationale_sha256"] == sha("why") and "rationale" not in second
    kept = readings.build_readings(spark.createDataFrame(good, SCHEMA), "t", keep_text=True).orderBy("n").collect()
    assert json.loads(kept[1].raw)["rationale"] == "why" and "rationale" not in json.loads(kept[0].raw)
    c = criteria(spark, [("a", 1, " one\r\ntwo\r ", None), ("a", 2, " \n", None), ("a", 3, None, None), ("a", 4, "x", "zz")]).orderBy("n").collect()
    assert c[0].sha == sha("one\ntwo") and json.loads(c[0].raw) == {"evt": "criterion", "format": "criterion/1", "criterion_sha256": sha("one\ntwo"), "text": "one\ntwo", "ts": "t"}
    assert [r.problem is None for r in c] == [True, False, False, False]


def plain_guard(rows, known):
    taken, out = set(known), {}
    for ledger, n, evt, digest, supersedes in sorted(rows, key=lambda r: r[1]):
        wanted = supersedes if evt == "criterion" else digest
        fine = wanted is None or (ledger, wanted) in taken
        out[ledger, n] = fine
        if evt == "criterion" and fine:
            taken.add((ledger, digest))
    return out


def test_guard_against_plain(spark):
    pick = random.Random(3)
    rows = []
    for n in range(400):
        evt = "criterion" if pick.random() < 0.5 else "reading"
        rows.append((pick.choice("ab"), n, evt, f"s{pick.randint(0, 60)}", f"s{pick.randint(0, 60)}" if evt == "criterion" and pick.random() < 0.8 else None))
    rows += [("c", n, "criterion", f"t{n}", f"t{n - 1}" if n else None) for n in range(8)] + [("c", 20, "reading", "t7", None)]
    known = [("a", "s1"), ("b", "s2"), ("b", "s3")]
    batch = spark.createDataFrame([(*r, "{}", None) for r in rows], readings.BATCH).repartition(3)
    got = {(r.ledger_id, r.n): r.problem is None for r in readings.guarded(batch, spark.createDataFrame(known, "ledger_id string, sha string")).collect()}
    assert got == plain_guard(rows, known)


def test_good_rows_are_appended_and_count_later(spark, tmp_path):
    folder = f"file://{tmp_path}/readings"
    first = criteria(spark, [("a", 1, "one", None), ("a", 2, "two", sha("one")), ("a", 3, "three", sha("zero"))]).unionAll(readings.build_readings(spark.createDataFrame([reading(0, sha("one")), reading(5, sha("two"))], SCHEMA), "t"))
    now, refused = readings.append(spark, folder, first)
    assert now.first().rows == 3 and now.first().ok and sorted((r.n, r.problem) for r in refused.collect()) == [(0, "criterion is not frozen earlier"), (3, "supersedes no earlier criterion")]
    now, refused = readings.append(spark, folder, readings.build_readings(spark.createDataFrame([reading(0, sha("one")), reading(0, sha("one"), ledger="b")], SCHEMA), "t"))
    assert [(r.ledger_id, r.rows) for r in now.collect()] == [("a", 4)] and [r.ledger_id for r in refused.collect()] == ["b"]
    assert appending.read(spark, folder).count() == 4


PATTERN = r"\d+ U\.S\. \d+"


def plain_lookup(text, said, most, per_request, rounds):
    parts = re.findall(r"(?s).+?(?:\n+|\Z)", text)
    offsets = [sum(map(len, parts[:i])) for i in range(len(parts))]
    groups = []
    for i, p in enumerate(parts):
        if groups and sum(len(parts[j]) for j in groups[-1]) + len(p) <= most:
            groups[-1].append(i)
        else:
            groups.append([i])

    def ask(piece, offset, attempt):
        return [(offset + m.start(), offset + m.end(), m[0], said.get((m[0], attempt), "not_found") if k < per_request else lookups.LIMITED, attempt) for k, m in enumerate(re.finditer(PATTERN, piece))]

    checks = [c for g in groups for c in ask("".join(parts[j] for j in g), offsets[g[0]], 1)]
    for attempt in range(2, rounds + 2):
        hot = {i for i, p in enumerate(parts) for c in checks if c[3] == lookups.LIMITED and offsets[i] <= c[0] < offsets[i] + len(p)}
        for i in hot:
            checks = [c for c in checks if not offsets[i] <= c[0] < offsets[i] + len(parts[i])] + ask(parts[i], offsets[i], attempt)
    return sorted(checks)


def test_lookups(spark):
    pick = random.Random(5)
    texts = []
    for key in range(12):
        paras = ["".join(f"see {pick.randint(1, 9)} U.S. {pick.randint(1, 9)} and " for _ in range(pick.randint(0, 6))) + "." for _ in range(pick.randint(1, 12))]
        texts.append((key, "\n\n".join(paras)))
    said = {(f"{a} U.S. {b}", t): pick.choice(["found", "ambiguous", lookups.LIMITED]) for a in range(1, 10) for b in range(1, 9) for t in range(1, 4)}
    answers = spark.createDataFrame([(*k, v) for k, v in said.items()], "cite string, attempt int, status string")
    df = spark.createDataFrame([*texts, (98, ""), (99, None)], "key int, text string")
    for per_request in (3, 250):
        got = {}
        for r in lookups.look_up(df, answers, PATTERN, most=200, per_request=per_request, rounds=2).collect():
            got.setdefault(r.key, []).append((r.start, r.stop, r.cite, r.status, r.attempts))
        for key, text in texts:
            assert got.get(key, []) == plain_lookup(text, said, 200, per_request, 2), key
        assert 98 not in got and 99 not in got
    assert lookups.look_up(df.limit(0), answers, PATTERN).collect() == []
