"""Near-duplicates by the exact Jaccard similarity of word shingles.

Words are op2's: A-Z lower-cased, cut at ASCII white space. A text is its set of
`width`-word shingles, as 64-bit hashes; a shorter text is one shingle, one
without words is the empty set. Two texts are linked at a similarity of
`SIMILAR` or more, and equal sets are one node.

Candidates come from prefixes: in any one order of all shingles, two sets as
similar as that share one of their first n - ceil(SIMILAR * n) + 1. The order is
by hash, with shingles that are common in a sample at the end, so the sample
bears on the cost alone. Of a shingle's texts each first meets the leader; then,
where these links leave more than one group, the texts outside of its largest
group meet all texts of other groups. Pairs count as far as enough shingles
stand behind the shared one in both and as their parity bits, of which each
shingle toggles one, are close enough to belong to similar sets. What is left is
pruned once more by as many parity bits as fit the sets' size, before any text
moves. No shingle has a cap, and every candidate left is settled by its whole
sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from plumbline.llm.common import materialize, pieces, settled, small_batches, texts
from plumbline.llm.components import components
from plumbline.llm.simhash import _hashes

SIMILAR = (4, 5)  # a fraction
SAMPLE, COMMON = 5_000, 1e-3
BITS = 1024


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    return np.unique(np.array(_hashes(text, width), np.uint64).view(np.int64))


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which a similar set has one among its own."""
    n = len(found)
    late = np.isin(found, common, assume_unique=True)
    return np.concatenate([found[~late], found[late]])[: n + (-SIMILAR[0] * n // SIMILAR[1]) + 1] if n else found


def parity(found: np.ndarray, bits: int = BITS) -> bytes:
    """So many bits (a power of two), each toggled by the shingles that fall on it: two sets differ in at least as many shingles as these in bits."""
    return np.packbits(np.bincount(found & (bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()


def sketch(found: np.ndarray) -> bytes:
    """Parity bits, at least twice as many as shingles."""
    return parity(found, max(BITS, 1 << (2 * len(found)).bit_length()))


def apart(x: bytes, y: bytes) -> int:
    """Differing bits of two sketches, at the width of the narrower: half a sketch is both of its halves put together."""
    a, b = (np.frombuffer(v, np.uint8) for v in sorted((x, y), key=len))
    return int(np.bitwise_count(np.bitwise_xor.reduce(b.reshape(-1, len(a))) ^ a).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= SIMILAR[0] * (len(a) + len(b) - both)


def common_shingles(rows: DataFrame, width: int) -> np.ndarray:
    """Shingles of at least a share COMMON of a sample of SAMPLE rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", max_bytes=4 << 20):
            found = np.concatenate([np.zeros(0, np.int64), *(shingles(t, width) for t in texts(batch, "text"))])
            keys, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["h", "n"])

    step = max(1, -(-rows.count() // SAMPLE))
    some = rows.where(F.pmod(F.xxhash64("n"), F.lit(step)) == 0).select("text")
    counts = some.transform(small_batches).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    least = max(8, int(COMMON * min(SAMPLE, rows.count())))
    return np.sort(np.asarray(counts.where(F.col("n") >= least).select("h").toArrow().column("h").combine_chunks(), np.int64))


def sets(rows: DataFrame, common: np.ndarray, width: int) -> DataFrame:
    """(place, n, sig, size, prefix, bits, sketch) of rows (place, n, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", max_bytes=8 << 20):
            found = [shingles(t, width) for t in texts(batch, "text")]
            new = [
                pa.array([xxh3_128_digest(s.tobytes()) for s in found], pa.binary()),
                pa.array([len(s) for s in found], pa.int32()),
                pa.array([prefix(s, common) for s in found], pa.list_(pa.int64())),
                pa.array([np.frombuffer(parity(s), np.int64) for s in found], pa.list_(pa.int64())),
                pa.array([sketch(s) for s in found], pa.binary()),
            ]
            keep = [batch.column(batch.schema.get_field_index(k)) for k in ("place", "n")]
            yield pa.RecordBatch.from_arrays([*keep, *new], names=["place", "n", "sig", "size", "prefix", "bits", "sketch"])

    schema = T.StructType([rows.schema["place"], rows.schema["n"]]).add("sig", T.BinaryType()).add("size", T.IntegerType()).add("prefix", T.ArrayType(T.LongType())).add("bits", T.ArrayType(T.LongType())).add("sketch", T.BinaryType())
    return rows.select("place", "n", "text").transform(small_batches).mapInArrow(run, schema)


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes (node, size, sketch) that can be similar by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("sizes", "a_sketch", "b_sketch"))
            good = [apart(u, v) * sum(SIMILAR) <= n * (SIMILAR[1] - SIMILAR[0]) for n, u, v in zip(sizes, x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda end: nodes.select(F.col("node").alias(end), F.col("size").alias(f"{end}_size"), F.col("sketch").alias(f"{end}_sketch"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("a_size") + F.col("b_size")).alias("sizes"), "a_sketch", "b_sketch")
    return materialize(met.transform(small_batches).mapInArrow(run, "a long, b long"))


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Of candidates (a, b), numbers of rows (n, text) and of nodes (node, size, sketch), the similar ones.

    Texts meet, not their sets: hashes don't compress, and take over twice the
    room of the words that they are made of.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            for end in ("a", "b"):
                for n, text in zip(batch.column(batch.schema.get_field_index(end)).to_pylist(), texts(batch, f"{end}_text")):
                    if n not in known:
                        known[n] = shingles(text, width)
            a, b = (batch.column(batch.schema.get_field_index(end)).to_pylist() for end in ("a", "b"))
            good = [similar(known[x], known[y]) for x, y in zip(a, b)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = possible(pairs, nodes)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    named = materialize(rows.join(ends, "n", "left_semi").select("n", "text"))
    met = pairs.join(named.select(F.col("n").alias("a"), F.col("text").alias("a_text")), "a").join(named.select(F.col("n").alias("b"), F.col("text").alias("b_text")), "b")
    return met.transform(small_batches).mapInArrow(settle, "a long, b long")


def _close(x: str, y: str) -> Column:
    """Whether two sets can be similar if the shingle at hand is the first they share: by sizes and by what stands behind it."""
    behind = F.least(F.col(f"{x}_size") - F.col(f"{x}_at"), F.col(f"{y}_size") - F.col(f"{y}_at"))
    return behind * sum(SIMILAR) >= (F.col(f"{x}_size") + F.col(f"{y}_size")) * SIMILAR[0]


def _alike(x: str, y: str) -> Column:
    """Whether two sets can be similar by their parity bits: similar ones differ in few shingles, so in few bits."""
    apart = sum(F.bit_count(F.get(f"{x}_bits", F.lit(i)).bitwiseXOR(F.get(f"{y}_bits", F.lit(i)))) for i in range(BITS // 64))
    return apart * sum(SIMILAR) <= (F.col(f"{x}_size") + F.col(f"{y}_size")) * (SIMILAR[1] - SIMILAR[0])


def _pruned(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that can be similar by their parity bits."""
    side = lambda x, end: nodes.select(F.col("node").alias(end), F.col("size").alias(f"{x}_size"), F.col("bits").alias(f"{x}_bits"))
    return pairs.join(side("x", "a"), "a").join(side("y", "b"), "b").where(_alike("x", "y")).select("a", "b")


def links(nodes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) of nodes (node, size, prefix, bits, sketch) that connect all similar ones, directly or over others."""
    at = nodes.select("node", "size", F.posexplode("prefix").alias("at", "h"))
    several = materialize(at.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"))
    shared = materialize(at.join(several, "h"))
    led = shared.groupBy("h").agg(F.min(F.struct("node", "size", "at")).alias("lead"))
    met = shared.join(led, "h").select(F.col("lead.node").alias("x"), F.col("lead.size").alias("x_size"), F.col("lead.at").alias("x_at"), F.col("node").alias("y"), F.col("size").alias("y_size"), F.col("at").alias("y_at"))
    spark = nodes.sparkSession
    tried = materialize(met.where((F.col("x") < F.col("y")) & _close("x", "y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    first = settled(spark, lambda: verified(materialize(_pruned(tried, nodes)), nodes, rows, width))
    roots = settled(spark, lambda: components(first))
    member = materialize(shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    groups = member.groupBy("h", "root").agg(F.count("*").alias("k"))
    split = groups.groupBy("h").agg(F.max_by("root", F.struct("k", "root")).alias("most"), F.count("*").alias("groups")).where("groups > 1").select("h", "most")
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("node", "size", "at", "root", "bits")]
    apart = materialize(member.join(split, "h").join(nodes.select("node", "bits"), "node"))
    left, right = apart.where("root <> most").select("h", *side("x")), apart.select("h", *side("y"))
    rest = left.join(right, "h").where((F.col("x_root") != F.col("y_root")) & _close("x", "y") & _alike("x", "y"))
    rest = rest.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    return first.unionAll(verified(materialize(rest.join(tried, ["a", "b"], "left_anti")), nodes, rows, width))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """The rows of documents, all columns, of which each group of near-duplicates keeps one.

    Which one stays is as in simhash.keep_first: of a group the row with the
    smallest doc_id, null ids last; of rows with that id the first by its text's
    hash and length, and of rows that are alike in all this any one.
    """
    taken = {c.lower() for c in docs.columns}
    at, n = (next(f"{c}_{i}" for i in range(len(taken) + 1) if f"{c}_{i}" not in taken) for c in ("place", "n"))
    place = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"), F.length(text).alias("length"))
    rows = materialize(docs.withColumn(at, place).withColumn(n, F.monotonically_increasing_id()))
    plain = rows.select(F.col(at).alias("place"), F.col(n).alias("n"), F.col(text).alias("text"))
    spark = docs.sparkSession
    found = materialize(sets(plain, common_shingles(plain, width), width))
    first = found.groupBy("sig").agg(F.min(F.struct("place", "n")).alias("first")).select("first.n")
    copies = materialize(found.select("n").join(first, "n", "left_anti"))
    nodes = found.join(copies, "n", "left_anti").select(F.col("n").alias("node"), "place", "size", "prefix", "bits", "sketch")
    pairs = settled(spark, lambda: links(materialize(nodes), plain, width))
    roots = settled(spark, lambda: components(pairs))
    linked = materialize(nodes.select("node", "place").join(roots, "node"))
    stay = linked.groupBy("root").agg(F.min(F.struct("place", "node")).alias("first")).select("first.node")
    gone = materialize(copies.unionAll(linked.select("node").join(stay, "node", "left_anti")))
    return rows.join(gone.withColumnRenamed("n", n), n, "left_anti").select(docs.columns)
