"""Evidence packs: an honest one is good, and each way to forge one is found by the check that is for it."""

from pyspark.sql import functions as F

from plumbline.operators import packs, rows

EVENTS = [("click", "05"), ("view", "10"), ("odd", "11"), (None, "12"), ("click", "13"), ("click", "20")]


def outcomes(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.pack, {})[r.check] = r.outcome
    return found


def world(spark):
    bodies = []
    for ledger in "ab":
        for i, (event, day) in enumerate(EVENTS, 1):
            said = "" if event is None else f'"event": "{event}", '
            bodies.append((ledger, i, f'{{{said}"id": {i}, "ts": "2024-01-{day}"}}'))
    source = rows.append(spark.createDataFrame(bodies, "ledger_id string, line long, body string")).select("ledger_id", "line", "raw").cache()
    pins = source.where("line = 4 and ledger_id = 'a'").select("ledger_id", F.col("line").alias("rows"), F.get_json_object("raw", "$.chain").alias("chain"))
    made = {k: v.cache() for k, v in packs.build(source, pins, "2024-01-10", "2024-01-13", ["click", "view"]).items()}
    ids = spark.createDataFrame([("a",), ("b",)], "pack string")

    def check(pack, source=source, store=pins):
        return outcomes(packs.check(ids, pack, source, store, "2024-01-10", "2024-01-13", ["click", "view"]))

    return source, pins, made, ids, check


def test_forgeries(spark):
    source, pins, made, ids, check = world(spark)
    good = check(made)
    assert good["a"] == {c: "good" for c in packs.CHECKS} and good["b"] == {**good["a"], "pins": "could_not_look"}
    fields = {(r.section, r.field): r.value for r in made["fields"].where("pack = 'a'").collect()}
    assert fields["export", "rows"] == "4" and fields["export", "first_line"] == "2" and fields["mandate", "denied"] == "1" and fields["mandate", "undecided"] == "1" and fields["export", "event:click"] == "1"
    sums = packs.verdicts(packs.check(ids, made, source, pins, "2024-01-10", "2024-01-13", ["click", "view"]))
    assert {r.pack: (r.verdict, r.bad, r.could_not_look) for r in sums.collect()} == {"a": ("good", 0, 0), "b": ("could_not_look", 0, 1)}

    def forged(**tables):
        new = made | tables
        return new | {"manifest": packs.sealed(ids, new["window"], new["fields"], new["pins"])}

    w, f = made["window"], made["fields"]
    changed = w.withColumn("raw", F.when((F.col("pack") == "a") & (F.col("line") == 3), F.replace("raw", F.lit("odd"), F.lit("view"))).otherwise(F.col("raw")))
    assert check(made | {"window": changed})["a"]["manifest"] == "bad"
    found = check(forged(window=changed))
    assert found["a"]["manifest"] == "good" and found["a"]["window"] == "bad" and found["a"]["mandate"] == "could_not_look" and found["b"] == good["b"]
    found = check(forged(window=w.where("line <> 3 or pack = 'b'")))["a"]
    assert found["window"] == "good" and found["complete"] == found["export"] == found["mandate"] == "bad"
    assert check(forged(window=w.unionAll(w.where("line = 2"))))["a"]["window"] == "bad"
    for section, field in (("export", "newest"), ("mandate", "allowed"), ("export", "head")):
        lied = f.withColumn("value", F.when(F.col("field") == field, "9").otherwise(F.col("value")))
        found = check(forged(fields=lied))["b"]
        assert found[section] == "bad" and found["window"] == "good" and (found["chain"] == "bad") == (field == "head")
    assert check(forged(fields=f.where("section <> 'mandate'")))["a"]["mandate"] == "bad"
    assert check(forged(fields=f.unionAll(spark.createDataFrame([("a", "export", "more", "1")], "pack string, section string, field string, value string"))))["a"]["export"] == "bad"
    assert check(made, store=pins.where("false"))["a"]["pins"] == "bad"
    assert check(made | {"manifest": made["manifest"].where("pack = 'b'")})["a"]["manifest"] == "could_not_look"
    found = check(made, source=source.where("ledger_id = 'b'"))
    assert found["a"]["window"] == found["a"]["complete"] == found["a"]["export"] == "could_not_look" and found["b"] == good["b"]


def test_what_could_not_be_read_is_stated(spark):
    _, pins, _, ids, _ = world(spark)
    bad = spark.createDataFrame([("a", 1, "{torn"), ("a", 2, '{"event": "click"}'), ("a", 3, ""), ("b", 1, '{"event": "view", "ts": "2023"}')], "ledger_id string, line long, raw string")
    made = packs.build(bad, pins.where("false"), "2024-01-10", "2024-01-13", ["click"])
    said = {(r.pack, r.field): r.value for r in made["fields"].where("section = 'statements'").collect()}
    assert said == {("a", "unreadable"): "1", ("a", "undated"): "1", ("b", "empty"): "1"}
    found = outcomes(packs.check(ids, made, bad, pins, "2024-01-10", "2024-01-13", ["click"]))
    assert found["a"]["statements"] == found["b"]["statements"] == "could_not_look" and found["b"]["export"] == "good"
    silent = made | {"fields": made["fields"].where("section <> 'statements'")}
    assert outcomes(packs.check(ids, silent, bad, pins, "2024-01-10", "2024-01-13", ["click"]))["a"]["statements"] == "bad"
    none = bad.limit(0)
    assert packs.check(ids.limit(0), packs.build(none, pins, "a", "b", []), none, pins, "a", "b", ["x"]).collect() == []
