"""What SQL can't say of scores and chunks, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import gates, scoring


def test_tokens_and_numbers(spark):
    rows = [("it is 40", "40"), ("it is 40.5", "40"), ("3.14.15", "3.14"), ("so 3.14, yes", "3.14"), ("1,40", "40"), ("40,5", "40"), ("paris.", "paris"), ("comparison", "paris"), ("a (b) c", "(b)"), ("", "x"), ("x", "")]
    got = spark.createDataFrame(rows, "t string, a string").select(scoring.holds_token(F.col("t"), F.col("a"))).collect()
    want = [bool(a) and re.search(r"(?<![\w.])" + re.escape(a) + r"(?!\w)(?![.,]?\d)", t) is not None for t, a in rows]
    assert [r[0] for r in got] == want


def test_whole_numbers(spark):
    cases = [("it is 1,234", 1234, True), ("it is 1,234", 234, False), ("it is 1e6", 1e6, True), ("it is 1e6", 6, False), ("-1,000.5e-1.", -100.05, True), ("v1.2.3", 1.2, False), ("x40", 40, False), ("40x", 40, True), ("a .5", 5, False), ("+7!", 7, True), ("\x1b[1m42\x1b[0m", 42, True), ("1,2345", 2345, True), ("none", 0, False), ("", 0, False)]
    got = spark.createDataFrame([(t, float(n)) for t, n, _ in cases], "t string, n double").select(scoring.holds_number(F.col("t"), F.col("n"), 1e-6)).collect()
    number = re.compile(r"(?<![\w.])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.]*\d)")
    for (text, value, want), row in zip(cases, got):
        found = [float(x.replace(",", "")) for x in number.findall(re.sub(r"\x1b\[[0-9;?]*[a-zA-Z]", "", text))]
        assert row[0] is any(abs(x - value) <= 1e-6 for x in found) is want, text


def test_items(spark):
    rows = [("exact_match", "London, Paris or Rome", "Paris", True, ["Rome"], 0.0), ("exact_match", "Paris", "Paris.", True, None, 1.0), ("exact_match", "anything", " ", True, None, 0.0), ("calibration", "London, Paris or Rome", "Paris", True, ["Rome"], 0.2), ("calibration", "I'm not sure. Paris", "Paris", True, None, 1.0), ("calibration", "unknowable", None, False, None, 1.0), ("calibration", "Oslo", "Paris", True, None, -1.0), ("calibration", "no  way of knowing", "Paris", True, None, 0.2), ("calibration", None, "Paris", True, None, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "kind string, said string, answer string, answerable boolean, wrong array<string>, want double, number double")
    c = F.col
    score = scoring.score_item(c("kind"), c("said"), c("answer"), c("number"), c("answerable"), 0.5, c("wrong"))
    assert [r[0] for r in df.select(score).collect()] == [r[-1] for r in rows]
    with pytest.raises(Exception, match="unknown scoring type typo"):
        df.where("said is not null").select(scoring.score_item(F.lit("typo"), c("said"), c("answer"), c("number"), c("answerable"))).collect()


def test_chunks_are_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("key"), "text").collect() + [(-1, ""), (-2, "a\n\n\n\nb"), (-3, "x" * 50 + "\nyy\nz")]
    got: dict = {}
    for most in (10, 300):
        got = {}
        for r in scoring.chunks(spark.createDataFrame([tuple(r) for r in rows], "key long, text string"), most).orderBy("key", "chunk").collect():
            got.setdefault(r.key, []).append((r.offset, r.size))
        for key, text in rows:
            parts, want, at = re.findall(r"(?s).+?(?:\n+|\Z)", text or ""), [], 0
            for p in parts:
                if want and want[-1][1] + len(p) <= most:
                    want[-1] = (want[-1][0], want[-1][1] + len(p))
                else:
                    want.append((at, len(p)))
                at += len(p)
            assert got.get(key, []) == want


def test_globs(spark):
    cases = [("view", "v*", True), ("view", "v?ew", True), ("view", "[a-v]iew", True), ("view", "[!a-v]iew", False), ("a.b", "a.b", True), ("axb", "a.b", False), ("a\nb", "a*b", True), ("view", "vie", False)]
    for name, glob, want in cases:
        assert spark.range(1).select(gates.matches(F.lit(name), [glob])).first()[0] is want
