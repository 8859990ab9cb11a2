"""How far the sources of each language differ in their words: systolic rotation.

A language keeps the terms that stand in at least `least_docs` of its documents.
A group (language, source) with N occurrences of the V kept terms gives a term
that it has c times the weight p = 1 + floor(10^9 (c + 1) / (N + V)); so does the
language as a whole. The divergence of p from q is floor((p - q)^2 / q).

Kept terms are dealt into slices of bounded size by their hash and numbered in
each. A group's counts in a slice are one compressed vector, which stays in its
partition. The peers circulate: in round r of a round-robin tournament over G
groups (G made even by a bye) the group numbered i meets the group numbered
r - i modulo G - 1, so that G - 1 rounds are all pairs once. The vector of one
of the two travels to the other's partition, and the meeting gives both
directions; slices add up. Rounds go in waves, whose number of rounds bounds what
a group receives at a time. Terms are ranked by local heaps in each partition,
whose survivors meet in one ranking.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bounded, materialize, pieces, small_batches, texts

LETTERS = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
GROUP = ["lang", "source"]
LOW_BITS = 40  # a task's occurrences of a term; its documents take the bits above
ONE, LOW, MOST_ROWS = 1 << LOW_BITS, (1 << LOW_BITS) - 1, 1 << 22


def counted(docs: DataFrame, lang: str, source: str, text: str, hold: int = 1 << 20) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up in each task over `hold` entries at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}  # documents in the upper bits, occurrences in the lower
        entries = rows = 0

        def out(step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
            for (a, b), terms in held.items():
                names, sums = list(terms), np.array(list(terms.values()), np.int64)
                for i in range(0, len(names), step):
                    part = sums[i : i + step]
                    kinds = [pa.array([x] * len(part), pa.string()) for x in (a, b)]
                    yield pa.RecordBatch.from_arrays([*kinds, pa.array(names[i : i + step], pa.binary()), pa.array(part & LOW), pa.array(part >> LOW_BITS)], names=[*GROUP, "term", "n", "docs"])

        for batch in pieces(batches, "text"):
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for key, data in zip(names, texts(batch, "text")):
                own = held.setdefault(key, {})
                entries -= len(own)
                for term, n in Counter(LETTERS.findall(data.lower())).items():
                    own[term] = own.get(term, 0) + n + ONE
                entries, rows = entries + len(own), rows + 1
                if entries > hold or rows >= MOST_ROWS:
                    yield from out()
                    held.clear()
                    entries = rows = 0
        yield from out()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"), (text, "text"))])
    return small_batches(rows).mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def weights(counts: np.ndarray, total: int | np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exactly: by long division, three digits at a time, as the product may not fit a long."""
    rest, found = counts + 1, np.zeros(len(counts), np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, np.maximum(total, 1))
        found = found * 1000 + digits
    return found + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers of at least 0, compressed, in as many bytes each as the largest needs; the first byte says how many."""
    size = next(b for b in (1, 2, 4, 8) if not len(values) or b == 8 or int(values.max()) >> (8 * b) == 0)
    return bytes([size]) + pa.compress(values.astype(f"<u{size}").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes | None, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    return np.frombuffer(pa.decompress(data[1:], n * data[0], codec="zstd", asbytes=True), f"<u{data[0]}").astype(np.int64)


def kept_counts(docs: DataFrame, lang: str, source: str, text: str, least_docs: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, slice, id, n, lang_n) of each group's kept terms, and (lang, kept, slices, lang_total).

    A task's counts are dealt by language and term once; the sums over the
    group and over the language are both made there. A slice has about `width`
    counts, so numbering its terms is a bounded sort.
    """
    term = ["lang", "term"]
    counts = counted(docs, lang, source, text).repartition(*term).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by = Window.partitionBy(*term)
    first = F.row_number().over(by.orderBy("source")) == 1
    rows = counts.withColumns({"lang_n": F.sum("n").over(by), "lang_docs": F.sum("docs").over(by), "first": first})
    rows = materialize(rows.where(F.col("lang_docs") >= least_docs).drop("docs", "lang_docs"))
    sizes = rows.groupBy("lang").agg(F.count_if("first").alias("kept"), F.sum(F.when(F.col("first"), F.col("lang_n"))).alias("lang_total"), F.ceil(F.count("*") / width).alias("slices"))
    sizes = materialize(sizes)
    sliced = rows.join(bounded(sizes.select("lang", "slices")), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), "slices"))
    numbered = sliced.withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1)
    return materialize(numbered.drop("slices", "first")), sizes


def members(docs: DataFrame, lang: str, source: str, sizes: DataFrame, held: DataFrame) -> DataFrame:
    """Every group with its number in its language (at), the language's groups (peers), and the sizes; languages without kept terms have one empty slice."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"))]).distinct()
    totals = held.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    known = groups.join(totals, GROUP, "left").join(sizes, "lang", "left")
    peers = Window.partitionBy("lang")
    return materialize(
        known.withColumns({
            "group": F.monotonically_increasing_id(),
            "at": F.row_number().over(peers.orderBy("source")).cast("long") - 1,
            "peers": F.count("*").over(peers),
            **{k: F.coalesce(k, F.lit(0)) for k in ("total", "kept", "lang_total")},
            "slices": F.coalesce("slices", F.lit(1)),
        })
    )


def vectors(held: DataFrame, groups: DataFrame) -> DataFrame:
    """A compressed vector for each group and slice, with what its meetings need."""
    key = ["lang", "slice", "source"]

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, counts = (np.asarray(group.column(c)) for c in ("id", "n"))
        packed = {k: pa.array([_packed(v)], pa.binary()) for k, v in (("ids", np.diff(ids, prepend=0)), ("counts", counts))}
        return pa.table({**{k: group.column(k)[:1] for k in key}, "own": pa.array([len(ids)], pa.int64()), **packed})

    packed = held.select(*key, "id", "n").groupBy(*key).applyInArrow(pack, "lang string, slice long, source string, own long, ids binary, counts binary")
    widths = held.groupBy("lang", "slice").agg((F.max("id") + 1).cast("long").alias("width"))
    every = groups.select(*GROUP, "at", "peers", "total", "kept", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    whole = every.join(packed, key, "left").join(bounded(widths), ["lang", "slice"], "left")
    return materialize(whole.withColumns({"own": F.coalesce("own", F.lit(0)), "width": F.coalesce("width", F.lit(0))}))


def partner(at: Column, turn: Column) -> Column:
    """The number of the group that the one numbered `at` meets in a round; `peers` or more: none."""
    last = F.col("peers") + F.pmod("peers", F.lit(2)) - 1
    other = F.pmod(turn - at, last)
    return F.when(at == last, F.pmod(turn * F.expr("(peers + pmod(peers, 2)) div 2"), last)).otherwise(F.when(other == at, last).otherwise(other))


LEADING = ["group", "term", "n", "lang_n", "total", "kept", "lang_total"]
VECTOR = ["total", "kept", "width", "own", "ids", "counts"]


class _Weights:
    """A group's weights in a slice: `rest` for every term but those it has."""

    def __init__(self, row: dict):
        self.ids = np.cumsum(_unpacked(row["ids"], row["own"]))
        total = row["total"] + row["kept"]
        self.values = weights(_unpacked(row["counts"], row["own"]), total)
        self.rest = weights(np.zeros(1, np.int64), total)

    def over(self, ids: np.ndarray) -> np.ndarray:
        found = np.full(len(ids), self.rest[0], np.int64)
        found[np.searchsorted(ids, self.ids)] = self.values
        return found


def meet(host: dict, guest: dict) -> tuple[int, int]:
    """Divergence of the host from the guest and of the guest from the host, over a slice's terms."""
    a, b = _Weights(host), _Weights(guest)
    ids = np.union1d(a.ids, b.ids)
    p, q, others = a.over(ids), b.over(ids), host["width"] - len(ids)
    return tuple(int(divergences(x, y).sum()) + others * int(divergences(u, v)[0]) for x, y, u, v in ((p, q, a.rest, b.rest), (q, p, b.rest, a.rest)))


def rotate(resident: DataFrame, first: int, last: int) -> DataFrame:
    """(lang, source, item, value): what the meetings of rounds first to last - 1 give, for each slice."""
    turns = F.explode(F.expr(f"filter(sequence({first}L, {last - 1}L), t -> t < peers + pmod(peers, 2) - 1)"))
    going = resident.select("*", turns.alias("turn")).withColumn("host", partner(F.col("at"), F.col("turn")))
    travels = (F.col("at") < F.col("host")) == (F.pmod(F.col("at") + F.col("host"), F.lit(2)) == 0)
    guests = going.where((F.col("host") < F.col("peers")) & travels).select("lang", "slice", F.col("host").alias("at"), "source", *VECTOR)

    def evaluate(own: pa.Table, others: pa.Table) -> pa.Table:
        found = []
        for host in own.to_pylist():
            for guest in others.to_pylist():
                there, back = meet(host, guest)
                found += [(host["lang"], host["source"], guest["source"], there), (host["lang"], guest["source"], host["source"], back)]
        columns = list(zip(*found)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=[*GROUP, "item", "value"])

    key = ["lang", "slice", "at"]
    return resident.select(*key, "source", *VECTOR).groupBy(*key).cogroup(guests.groupBy(*key)).applyInArrow(evaluate, "lang string, source string, item string, value long")


def settle(vectors: DataFrame) -> DataFrame:
    """The vectors in the partitions they stay in; those of a lost executor come again from the written table."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    resident = vectors.repartition(parts, "lang", "slice", "at").persist(StorageLevel.MEMORY_AND_DISK)
    resident.count()  # once they are there, their partitioning is known and no wave deals them anew
    return resident


def pair_divergences(vectors: DataFrame, wave: int = 8) -> DataFrame:
    """(lang, source, item, value) for every two groups of a language, in both directions; `wave` rounds go in one job."""
    resident = settle(vectors)
    rounds = vectors.agg(F.max(F.col("peers") + F.pmod("peers", F.lit(2)) - 1)).first()[0] or 0
    found = vectors.sparkSession.createDataFrame([], "lang string, source string, item string, value long")
    for first in range(0, rounds, wave):
        found = found.unionAll(materialize(rotate(resident, first, min(first + wave, rounds))))
    resident.unpersist()
    return found.groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))


def leading_terms(held: DataFrame, groups: DataFrame, ranks: int, hold: int = 1 << 18) -> DataFrame:
    """(group, item, value) of the terms that a group has more of than its language: each partition's `ranks` first at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[int, bytes]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for group, heap in heaps.items():
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(heap), pa.int64()), pa.array([t for _, t in heap], pa.binary()), pa.array([-v for v, _ in heap], pa.int64())], names=["group", "item", "value"])

        for batch in batches:
            column = {c: np.asarray(batch.column(i)) for i, c in enumerate(LEADING) if c != "term"}
            p = weights(column["n"], column["total"] + column["kept"])
            q = weights(column["lang_n"], column["lang_total"] + column["kept"])
            values = divergences(p, q)
            more = np.flatnonzero(p > q)
            more = more[np.argsort(column["group"][more], kind="stable")]
            names, starts = np.unique(column["group"][more], return_index=True)
            for group, at in zip(names.tolist(), np.split(more, starts[1:])):
                heap = heaps.get(group, [])
                if len(heap) == ranks:
                    at = at[values[at] >= -heap[-1][0]]
                if len(at) > ranks:
                    at = at[values[at] >= np.partition(values[at], -ranks)[-ranks]]
                terms = batch.column(LEADING.index("term")).take(pa.array(at)).to_pylist()
                heaps[group] = sorted([*heap, *zip((-values[at]).tolist(), terms)])[:ranks]
            if sum(map(len, heaps.values())) > hold:
                yield from out()
                heaps.clear()
        yield from (b for b in out() if b.num_rows)

    rows = held.join(bounded(groups.select(*GROUP, "group", "total", "kept", "lang_total")), GROUP).select(*LEADING)
    return rows.mapInArrow(run, "group long, item binary, value long")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, ranks: int = 200, width: int = 1 << 19, wave: int = 8) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: the group's divergence from each other group of its language,
    summed over all kept terms. Part `term`: the terms of the group that its
    language has less of by weight, the `ranks` with the largest divergence.
    Ranks count from 1, larger values first, equal ones by the item's bytes.

    Null texts, languages and sources count as empty ones; a group without terms
    meets its peers like any other; a language that keeps no term has pairs of
    value 0. Repeated rows are documents of their own, an empty table gives an
    empty result, other columns play no part. `width` and `wave` bound a slice
    and a job and change no result.
    """
    held, sizes = kept_counts(docs, lang, source, text, least_docs, width)
    groups = members(docs, lang, source, sizes, held)
    pairs = pair_divergences(vectors(held, groups), wave)
    order = F.desc("value"), "item"
    place = F.row_number().over(Window.partitionBy("group").orderBy(*order))
    leading = leading_terms(held, groups, ranks).withColumn("rank", place).where(F.col("rank") <= ranks)
    leading = leading.join(bounded(groups.select(*GROUP, "group")), "group")
    pairs = pairs.select(*GROUP, F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy(*GROUP).orderBy(*order)).alias("rank"))
    return pairs.unionAll(leading.select(*GROUP, F.lit("term").alias("part"), F.col("item").cast("string"), "value", "rank"))
