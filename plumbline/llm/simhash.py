"""SimHash near-duplicates by multi-index hashing.

Fingerprint: A-Z lower-cased, words are runs of other than space, tab, LF, VT,
FF and CR; every three consecutive words (repeats included), joined by one
space, give an XXH64 with seed 42; a bit is one if it is set in more than half
of these hashes. One or two words make one shingle; none, or a null text, give
fingerprint zero, which links like any other.

Links: two fingerprints with at most `radius` differing bits. The 64 bits are
cut into segments; if all segments were further apart than their share of the
radius, the whole would be too, so at least one segment lies in a small ball.
Each fingerprint looks up the ball around each of its segments in the table of
segments, and the full distance settles every match. No bucket has a cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from plumbline.llm.common import materialize, pieces, small_batches, texts, with_columns
from plumbline.llm.components import components

SEED = 42


def _hashes(text: bytes, width: int) -> list[int]:
    words = text.lower().split()  # bytes: ASCII only, both the case and the white space
    if not words:
        return []
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return [xxh64_intdigest(s, SEED) for s in shingles]


def fingerprint(text: bytes, width: int = 3, block: int = 1 << 16) -> int:
    """The 64-bit SimHash of one UTF-8 text; bounded memory for very long ones."""
    hashes = _hashes(text, width)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):
        part = np.array(hashes[i : i + block], np.uint64).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int32)
    ones = (votes * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 3) -> DataFrame:
    """The kept columns and `fp`, the fingerprint as a signed long, for every row."""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            fps = np.array([fingerprint(t, width) for t in texts(batch, text)], np.uint64).view(np.int64)
            yield with_columns(batch, names, {"fp": pa.array(fps, pa.int64())})

    fields = [T.StructField(n, docs.schema[n].dataType) for n in names]
    return docs.select(*dict.fromkeys([*names, text])).transform(small_batches).mapInArrow(run, T.StructType([*fields, T.StructField("fp", T.LongType(), False)]))


def segments(radius: int) -> list[tuple[int, int, int]]:
    """(shift, bits, ball radius) of each segment for a radius over 64 bits.

    With m segments and radius r = m*q + s, a pair within r has a segment among
    the first s + 1 within q, or one of the others within q - 1.
    """
    m = radius // 2 + 1 if radius else 1
    q, s = divmod(radius, m)
    size, found = 64 // m, []
    for k in range(m):
        ball = q if k <= s else q - 1
        if ball >= 0:
            found.append((k * size, 64 - k * size if k == m - 1 else size, ball))
    return found


def _masks(bits: int, ball: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(ball + 1) for c in combinations(range(bits), n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints `fp` with at most `radius` differing bits."""
    table, probes = [], []
    for n, (shift, bits, ball) in enumerate(segments(radius)):
        key = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(_signed((1 << bits) - 1)))
        part = nodes.select("fp", F.lit(n).alias("segment"), key.alias("key"))
        table.append(part.withColumnRenamed("fp", "b"))
        masks = F.array(*[F.lit(_signed(m)) for m in _masks(bits, ball)])
        probes.append(part.select(F.col("fp").alias("a"), "segment", F.explode(F.transform(masks, lambda m: F.col("key").bitwiseXOR(m))).alias("key")))
    table, probes = _union(table), _union(probes)
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    hit = (table["segment"] == probes["segment"]) & (table["key"] == probes["key"]) & near
    return probes.join(table, hit).select("a", "b").distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id among all rows reachable over links. A
    null doc_id never is a component_id unless its whole group has none. Rows
    with the same fingerprint are one node of the graph, so groups of exact
    copies cost nothing; repeated rows come back as often as they came. Other
    columns of the input play no part. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(fingerprints(rows))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes, radius))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    owner = joined.join(least, "root").select("fp", "component_id")
    return rows.join(owner, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """The rows of documents, all columns, of which each group of near-duplicates keeps one.

    Of a group the row with the smallest doc_id stays, null ids last; of rows
    with that id the first by its text's hash and length, and of rows that are
    alike in all this any one. The table may have any other columns.
    """
    row = next(n for n in (f"row_{i}" for i in range(len(docs.columns) + 1)) if n not in {c.lower() for c in docs.columns})
    place = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.xxhash64(text), F.length(text))
    rows = materialize(docs.withColumn(row, F.struct(place.alias("place"), F.monotonically_increasing_id().alias("n"))))
    fps = materialize(fingerprints(rows, text, keep=(row,), width=width).withColumnRenamed(row, "at"))
    nodes = materialize(fps.groupBy("fp").agg(F.min("at").alias("first")))
    roots = components(links(nodes.select("fp"), radius))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = joined.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.n").alias("kept_n"))
    numbers = fps.select(F.col("at.n").alias("gone_n"))
    gone = materialize(numbers.join(kept, numbers["gone_n"] == kept["kept_n"], "left_anti"))
    return rows.join(gone, rows[row]["n"] == gone["gone_n"], "left_anti").drop(row).select(docs.columns)
