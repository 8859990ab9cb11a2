"""A training-data pipeline over documents: each stage is one of the llm operators.

Every stage but the last returns rows of documents with all their columns and
drops the rows it decides against; the last packs what is left.

Null texts go in the first stage, having no letter. Null ids are ids like any
other, repeated rows are copies of which one stays, other columns are kept as
they are, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, langid, neardup, packing, simhash, toxicity
from plumbline.llm.common import materialize, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those that no language claims."""
    return langid.keep_identified(docs, langid.learn(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that SimHash links, and of what is left of each group alike in 0.8 of its shingles.

    Fingerprints of five-word shingles with at most two differing bits find
    copies; texts with a Jaccard similarity of 0.8 differ in some ten bits, out
    of reach of Hamming balls, so the exact join over the same shingles follows.
    """
    return neardup.keep_first(simhash.keep_first(docs, width=5))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontaminate.keep_uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Trained models and packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each one's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
