"""Token ids: both libraries give the same, on any text."""

import numpy as np
import pytest

from plumbline.llm import lengths, packing
from plumbline.llm.tokens import encode, parts, tokenizer

ODD = [" " * 3000 + "x", "\n" * 2500, "a" * 5000, "中" * 3000, "word " * 400, "<|endoftext|>", "", " \n\t" * 900 + "'s it's", "²½Ⅷ①" * 400, "🙂" * 1200, "ab12 " * 3 + "é" * 1100]


@pytest.mark.parametrize("text", ODD)
def test_same_ids_as_the_named_library(text):
    assert encode(text).tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_parts_are_encoded_alike():
    text = "It's one, two; naïve 12ab\n\n  don't 中文。字 x²y " * 300
    cut = list(parts(text, 50))
    assert len(cut) > 50 and "".join(cut) == text
    assert np.concatenate([encode(p) for p in cut]).tolist() == encode(text).tolist()


def test_over_a_megabyte_of_one_character(spark):
    rows = [(i, c * 1_200_000) for i, c in enumerate((" ", "\n", "a"))] + [(3, "中" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sum(r.n_docs for r in lengths.token_counts(docs).collect()) == 4
    pieces = packing.pack(docs.where("doc_id < 2")).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in pieces} == {i: len(encode(rows[i][1])) + 1 for i in (0, 1)}
