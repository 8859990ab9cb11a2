"""Receipts issued and checked whole, and every way to spoil one."""

import json

from plumbline.functions.canon import digest, link
from plumbline.operators import documents
from plumbline.sources import appending

SCOPE = json.dumps({"proves": ["a"], "does_not_prove": ["b"]})
BODIES = "id long, ledger_id string, n long, kind string, subject string, checks string, scope string, extra string"


def test_issue_and_check(spark, tmp_path):
    folder = f"file://{tmp_path}/receipts"
    good = [(i, "ab"[i % 2], i, "call", json.dumps({"é": i}), json.dumps([{"c": j} for j in range(i % 4)]), SCOPE, "{}") for i in range(12)]
    bad = [(20, "a", 1, "call", "[]", "[]", SCOPE, "{}"), (21, "a", 1, None, "{}", "[]", SCOPE, "{}"), (22, "a", 1, "call", "{}", "[]", '{"proves": ["a"], "does_not_prove": []}', "{}"), (23, None, 1, "call", "{}", "[]", SCOPE, "{}"), (24, "a", 1, "call", '{"x": NaN}', "[]", SCOPE, "{}")]
    made, refused = documents.issue(spark, folder, spark.createDataFrame(good + bad, BODIES).repartition(3), "2026-01-01T00:00:00Z")
    assert {r.id for r in refused.collect()} == {20, 21, 22, 23, 24}
    made = {r.id: r for r in made.collect()}
    assert set(made) == set(range(12))
    first = json.loads(made[2].raw)
    assert first["ledger"]["rows"] == 2 and first["body_digest"] == digest({k: first[k] for k in documents.BODY})
    lines = appending.read(spark, folder).cache()

    def check(*documents_, store=lines):
        rows = [(i, ledger, raw) for i, (ledger, raw) in enumerate(documents_)]
        df = spark.createDataFrame(rows, "id int, ledger_id string, raw string").selectExpr("*", "1 AS state", "2 AS line")
        return [tuple(r)[1:] for r in documents.check(df, store).orderBy("id").collect()]

    def changed(i=2, **more):
        return json.dumps(json.loads(made[i].raw) | more)

    whole = [(r.ledger_id, r.raw) for r in made.values()]
    assert set(check(*whole, whole[0])) == {(True, False, "consistent", "absent", "absent", True)}
    pin = {"rows": 2, "chain": first["ledger"]["chain"], "namespace": "a", "prev": "genesis"}
    pin["self"] = link("", pin, ("prev", "self"))
    witness = {"kind": "hosted", "rows": 2, "chain": pin["chain"], "namespace": "a", "pin": pin}
    sign = {"body_digest": first["body_digest"], "value": "v"}
    cases = {
        "body": (("a", changed(subject={})), (False, False, "consistent", "absent", "absent", False)),
        "twice": (("a", '{"kind": "x", ' + made[2].raw[1:]), (True, True, "consistent", "absent", "absent", False)),
        "alone": ((None, made[2].raw), (True, False, "not_checked", "absent", "absent", True)),
        "other": (("b", made[2].raw), (True, False, "row_not_found", "absent", "absent", False)),
        "gone": (("z", made[2].raw), (True, False, "missing", "absent", "absent", None)),
        "rows": (("a", changed(ledger=first["ledger"] | {"rows": 3})), (True, False, "head_mismatch", "absent", "absent", False)),
        "no rows": (("a", changed(ledger=5)), (True, False, "row_not_found", "absent", "absent", False)),
        "witness": (("a", changed(witness=witness)), (True, False, "consistent", "claimed", "absent", True)),
        "witness rows": (("a", changed(witness=witness | {"rows": 4})), (True, False, "consistent", "inconsistent", "absent", False)),
        "pin": (("a", changed(witness=witness | {"pin": pin | {"as_of": "later"}})), (True, False, "consistent", "inconsistent", "absent", False)),
        "no pin": (("a", changed(witness={"status": "skipped"})), (True, False, "consistent", "absent", "absent", True)),
        "signed": (("a", changed(attestation_signature=sign)), (True, False, "consistent", "absent", "could_not_look", True)),
        "signed else": (("a", changed(attestation_signature=sign | {"body_digest": "x"})), (True, False, "consistent", "absent", "mismatch", False)),
        "signed over": (("a", changed(attestation_signature=sign | {"signed_over": "file"})), (True, False, "consistent", "absent", "mismatch", False)),
        "torn": (("a", made[2].raw[:50]), (None, None, None, None, None, None)),
        "list": (("a", "[]"), (None, None, None, None, None, None)),
        "null": (("a", None), (None, None, None, None, None, None)),
    }
    for (name, (_, want)), got in zip(cases.items(), check(*[c for c, _ in cases.values()])):
        assert got == want, name
    broken = lines.where("ledger_id = 'a'").selectExpr("ledger_id", "line", "CASE WHEN line = 5 THEN replace(raw, 'call', 'cell') ELSE raw END AS raw")
    assert check(whole[0], store=broken)[0][2] == "chain_broken" and check(whole[0], store=lines.limit(0))[0][2] == "missing"
    assert check() == []
