"""License scans against a plain word-by-word version."""

import re

from plumbline.llm import licenses as L

GNU = f"licensed under the {L.NAMES['gpl-3']}"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w = words(text)
    at, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = L.scan(docs).collect()
    assert len(rows) == len(text)
    gnu = " ".join(words(GNU))
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text[r.doc_id])
        assert ("gpl-3" in r.labels.split(",")) == (f" {gnu} " in f" {' '.join(words(text[r.doc_id]))} ")
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert sum(r.labels != r.base_labels for r in rows) > 3


def test_near_notices_and_odd_rows(spark):
    gnu = GNU
    rows = [
        (1, "Before it. " + GNU.replace("GNU", "the GNU") + ". After it", "x"),  # a word more
        (2, gnu.replace("General ", ""), "x"),  # a word less
        (3, gnu.replace("licensed", "licenced"), "x"),  # a word misspelt
        (4, " ".join(gnu.split()[:5]), "x"),  # too little of it
        (5, None, "x"),
        (6, "", None),
        (7, "cc-by-nc CC BY NC cc/by/nc " * 20000, "x"),
        (8, "MIT Licence. Mit und. Under the MIT-License\x00 apache license, version 2", "x"),
        (9, (gnu + " é ") * 3, "x"),
        (None, gnu, "x"),
        (1, "Before it. " + GNU.replace("GNU", "the GNU") + ". After it", "x"),
    ]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((d, *base(t)) for d, t, _ in rows), key=str)
    by = {r.doc_id: r for r in got}
    assert [by[d].labels for d in (1, 2, 3, 4, 5, 6, None)] == ["gpl-3"] * 3 + ["", "", "", "gpl-3"]
    assert by[8].labels == "apache-2,mit" and by[7].labels == "cc-by-nc" and by[7].score == 1
    phrase = {"gpl-3": " ".join(words(GNU))}
    for d in (1, 2, 3, 9):
        w = words(next(t for i, t, _ in rows if i == d))
        for s in by[d].spans:
            found = " ".join(w[s.begin : s.end + 1])
            assert abs(s.alike - (1 - distance(found, phrase["gpl-3"]) / max(len(found), len(phrase["gpl-3"])))) < 1e-9
    assert len(by[9].spans) == 3
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_notices_and_many_licenses(spark):
    """A text of notices only; each notice of every license is found under its own label."""
    rows = [(i, f"Some words before it. {text}; and some behind it.") for i, (_, text) in enumerate(L.TEMPLATES)]
    rows += [(1000, (GNU + " and so on ") * 4000)]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(L.TEMPLATES):
        assert label in got[i].labels.split(",") or label in ("bsd", "lgpl", "isc"), (label, got[i].labels)
    assert len(L.NAMES) >= 60 and len(got[1000].spans) == 4000
