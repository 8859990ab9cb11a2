"""Exact token counts for every context limit, from one histogram of lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, pieces, small_batches, texts
from plumbline.llm.tokens import encode


def histogram(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(length, n_docs) for every encoded length; a null text counts as empty (length 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, max_bytes=4 << 20):
            length, n = np.unique(np.array([len(encode(t.decode("utf-8", "replace"), path)) for t in texts(batch, text)], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], names=["length", "n_docs"])

    return docs.select(text).transform(small_batches).mapInArrow(run, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(counts: DataFrame, block: int = 1024) -> DataFrame:
    """For each length as a context limit, what suffix sums of the histogram answer.

    length: the limit; n_docs: documents of just this length; docs_above and
    tokens_above: documents longer than it (those cut there), and their tokens;
    tokens_kept: tokens left when every document is cut at the
    limit; tokens_lost: the rest; docs_total, tokens_total: of the corpus;
    quantile: share of documents no longer than the limit. Sums run inside
    blocks of lengths and over the blocks' totals, so that no task has to hold
    all lengths.
    """
    rows = counts.withColumn("block", F.floor(F.col("length") / block)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    totals = totals.select("block", over("d", after).alias("d_after"), over("t", after).alias("t_after"), over("d", whole).alias("docs_total"), over("t", whole).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("d_in", over("n_docs", inside)).withColumn("t_in", over("tokens", inside)).join(totals, "block")
    above, beyond = F.col("d_in") + F.col("d_after"), F.col("t_in") + F.col("t_after")
    kept = F.col("tokens_total") - beyond + F.col("length") * above
    return rows.select("length", "n_docs", above.alias("docs_above"), beyond.alias("tokens_above"), kept.alias("tokens_kept"), (F.col("tokens_total") - kept).alias("tokens_lost"), "docs_total", "tokens_total", ((F.col("docs_total") - above) / F.col("docs_total")).alias("quantile"))


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """tokens_kept and docs_cut when every document is cut at any limit, in the histogram or not.

    The answer comes from the longest length up to the limit: documents above
    it are above the limit too. One row; none for an empty corpus.
    """
    below = sums.where(F.col("length") <= limit).orderBy(F.desc("length")).limit(1).select((F.col("tokens_total") - F.col("tokens_above") + F.col("docs_above") * limit).alias("tokens_kept"), F.col("docs_above").alias("docs_cut"))
    least = sums.orderBy("length").limit(1).where(F.col("length") > limit).select((F.col("docs_total") * limit).alias("tokens_kept"), F.col("docs_total").alias("docs_cut"))
    return below.unionAll(least)


def length_quantile(sums: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least this share of the documents doesn't exceed; one row `length`."""
    return sums.where(F.col("quantile") >= share).agg(F.min("length").alias("length"))


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """suffix_sums of the documents' histogram, written once; an empty table gives an empty result."""
    return suffix_sums(materialize(histogram(docs, text, path)))
