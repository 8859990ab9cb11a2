"""Ranked lexical search: Block-Max WAND over a compressed inverted index.

Index. Documents are cut into shards of bounded text. A shard numbers its
documents in order of their ids and holds, for each term, the numbers of the
documents that have it and how often, in blocks of BLOCK postings: gaps and
counts in as few bytes each as the block's largest needs. Beside the bytes stand,
for each block, its last document and the maximum impact of its postings; a
posting's impact is its score without the term's weight.

Search. Queries go in packs of bounded size; a pack meets a shard in one task
with the shard's lists of the pack's terms. Each query walks its lists document
by document: the pivot is the first document whose lists' maxima could pass the
threshold, the k-th best score so far. Before anything is decompressed, shallow
moves find each list's block for the pivot by the blocks' last documents; if the
blocks' maxima cannot pass, all lists skip to the nearest block's end. Only what
can pass is decompressed and scored, in whole numbers, so the result is exact.
A few shards go first; the k-th best scores there are where the others start.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import bounded, materialize, pieces, small_batches, texts

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLOCK = 128
SHARD_BYTES = 16 << 20
PACK = 256
PACK_TERMS = 1 << 16
MAX_DOCS = 1 << 20
INDEX_BITS = 33
FIRST = 8  # one shard of so many goes first
NO_TERM = b""  # stands for a shard's documents
LISTS = ["shard", "term", "n", "lasts", "impacts", "ends", "data", "ids", "m"]


def terms_of(text: bytes) -> list[bytes]:
    """Terms in order; bytes.lower() changes A-Z alone."""
    return TERM.findall(text.lower())


def sizes(docs: DataFrame, text: str) -> tuple[int, int]:
    """Documents with a term, and terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in pieces(batches, text):
            for data in texts(batch, text):
                n = len(terms_of(data))
                documents, terms = documents + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], names=["documents", "terms"])

    found = small_batches(docs.select(text)).mapInArrow(run, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def lengths_term(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of each document: 25 and 75 times its share of the mean length."""
    return np.array([25 + 75 * n * documents // max(terms, 1) for n in lengths.tolist()], np.int64)


def impacts_of(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def _bytes_needed(largest: np.ndarray) -> np.ndarray:
    return 1 + (largest > 0xFF) + 2 * (largest > 0xFFFF)


def postings(documents: list[np.ndarray], number: dict[bytes, int], m: np.ndarray) -> tuple[list[bytes], list[pa.Array]]:
    """The terms of a shard and their n, lasts, impacts, ends and data, from its documents' terms as numbers."""
    ids = np.concatenate([np.zeros(0, np.int64), *documents])
    if not len(ids):
        return [], [pa.array([], t) for t in (pa.int64(), *[pa.list_(pa.int32())] * 3, pa.binary())]
    names = sorted(number)
    rank = np.empty(len(names), np.int64)
    rank[[number[w] for w in names]] = np.arange(len(names))
    doc = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    keys, counts = np.unique(rank[ids] * len(documents) + doc, return_counts=True)
    term, doc = np.divmod(keys, len(documents))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    held = np.diff(starts, append=len(term))
    place = np.arange(len(term)) - np.repeat(starts, held)
    gaps = np.where(place == 0, doc + 1, np.diff(doc, prepend=0)) - 1
    first = np.flatnonzero(place % BLOCK == 0)  # of each block
    n = np.diff(first, append=len(term))
    gap_bytes, count_bytes = (_bytes_needed(np.maximum.reduceat(v, first)) for v in (gaps, counts))
    head = np.cumsum(1 + n * (gap_bytes + count_bytes)) - (1 + n * (gap_bytes + count_bytes))
    out = np.zeros(int(head[-1] + 1 + n[-1] * (gap_bytes[-1] + count_bytes[-1])), np.uint8)
    out[head] = gap_bytes * 16 + count_bytes
    block, inside = np.repeat(np.arange(len(first)), n), place % BLOCK
    for values, width, at in ((gaps, gap_bytes, head + 1), (counts, count_bytes, head + 1 + n * gap_bytes)):
        where, wide = at[block] + inside * width[block], width[block]
        for i in range(4):
            use = wide > i
            out[where[use] + i] = values[use] >> (8 * i) & 0xFF
    of_term = term[first]
    blocks = np.flatnonzero(np.diff(of_term, prepend=-1))  # each term's first block
    edges = np.append(blocks, len(first))
    begin = head[blocks]
    finish = np.append(begin[1:], len(out))
    ends = np.append(head[1:], len(out)) - np.repeat(begin, np.diff(edges))
    top = np.maximum.reduceat(impacts_of(counts, m[doc]), first)
    lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(v.astype(np.int32))) for v in (doc[first + n - 1], top, ends)]
    data = pa.array([out[a:b].tobytes() for a, b in zip(begin.tolist(), finish.tolist())], pa.binary())
    return names, [pa.array(held), *lists, data]


def decoded(data: bytes, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and counts of one block; `base` is the last document of the block before, -1 for the first."""
    gap_bytes, count_bytes = divmod(data[0], 16)
    n = (len(data) - 1) // (gap_bytes + count_bytes)
    gaps = np.frombuffer(data, f"<u{gap_bytes}", n, 1).astype(np.int64)
    counts = np.frombuffer(data, f"<u{count_bytes}", n, 1 + n * gap_bytes).astype(np.int64)
    return base + np.cumsum(gaps + 1), counts


class Shard:
    """Documents on their way into a shard's lists."""

    def __init__(self):
        self.ids, self.documents, self.size = [], [], 0
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__

    def add(self, doc_id, text: bytes) -> None:
        found = terms_of(text)
        self.documents.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))
        self.ids.append(doc_id)
        self.size += len(text)

    def rows(self, shard: int, documents: int, terms: int, kind: pa.DataType, step: int = 4096) -> Iterator[pa.RecordBatch]:
        """A row for the documents, in order of their ids, nulls last, and a row a term."""
        order = sorted(range(len(self.ids)), key=lambda i: (1, i) if self.ids[i] is None else (0, self.ids[i], i))
        sorted_documents = [self.documents[i] for i in order]
        m = lengths_term(np.array([len(d) for d in sorted_documents], np.int64), documents, terms)
        ids = pa.array([[self.ids[i] for i in order]], pa.list_(kind))
        ints = pa.array([[]], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([NO_TERM], pa.binary()), pa.array([len(order)]), ints, ints, ints, pa.array([b""], pa.binary()), ids, pa.array([m])], names=LISTS)
        names, arrays = postings(sorted_documents, self.number, m)
        n = len(names)
        more = [pa.nulls(n, pa.list_(kind)), pa.nulls(n, pa.list_(pa.int64()))]
        whole = pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(names, pa.binary()), *arrays, *more], names=LISTS)
        for i in range(0, n, step):
            yield whole.slice(i, step)


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """The written index of all documents and the number of those that have a term.

    One row for each shard and term (n postings; for each block its last
    document, largest impact and end in `data`), and one with the empty term for
    each shard's ids and m. A shard takes documents of one task until they have
    `shard_bytes` of text.
    """
    documents, terms = sizes(docs, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, kind = Shard(), TaskContext.get().partitionId() << INDEX_BITS, None
        for batch in pieces(batches, "text"):
            kind = batch.column(0).type
            for name, data in zip(batch.column(0).to_pylist(), texts(batch, "text")):
                held.add(name, data)
                if held.size >= shard_bytes or len(held.ids) >= MAX_DOCS:
                    yield from held.rows(shard, documents, terms, kind)
                    held, shard = Shard(), shard + 1
        if held.ids:
            yield from held.rows(shard, documents, terms, kind)

    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    kinds = [T.LongType(), T.BinaryType(), T.LongType(), ints, ints, ints, T.BinaryType(), T.ArrayType(id_type), longs]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(LISTS, kinds)])
    return materialize(small_batches(rows).mapInArrow(run, schema)), documents


class List:
    """A term's list in a shard; blocks are decompressed when first read, for all queries of the task."""

    def __init__(self, lasts: list[int], impacts: list[int], ends: list[int], data: bytes, m: np.ndarray):
        self.lasts, self.impacts, self.top = lasts, impacts, max(impacts)
        self._ends, self._data, self._m = ends, data, m
        self._read: list[tuple[list[int], list[int]] | None] = [None] * len(lasts)

    def block(self, b: int) -> tuple[list[int], list[int]]:
        """Documents and impacts."""
        found = self._read[b]
        if found is None:
            docs, counts = decoded(self._data[self._ends[b - 1] if b else 0 : self._ends[b]], self.lasts[b - 1] if b else -1)
            found = self._read[b] = docs.tolist(), impacts_of(counts, self._m[docs]).tolist()
        return found

    def blocks_read(self) -> int:
        return sum(r is not None for r in self._read)


PLACE_BITS = 20
PLACE = (1 << PLACE_BITS) - 1


def walk(lists: list[List], weights: list[int], k: int, floor: int) -> list[tuple[int, int]]:
    """(score, document) of the k best of a shard with a score above 0 and of at least `floor`, the smaller document first among equals."""
    least = max(floor - 1, 0)  # what a document must pass
    best: list[tuple[int, int]] = []
    tops = [a.top * w for a, w in zip(lists, weights)]
    block, read = [0] * len(lists), [-1] * len(lists)
    docs: list[list[int]] = [[]] * len(lists)
    impacts: list[list[int]] = [[]] * len(lists)
    at = [0] * len(lists)  # place in the block read
    order = list(range(len(lists)))  # the next document, or a bound below it, and the list's number
    while True:
        order.sort()
        bound = 0
        for p, key in enumerate(order):
            bound += tops[key & PLACE]
            if bound > least:
                break
        else:
            break
        pivot = order[p] >> PLACE_BITS
        end = p + 1
        while end < len(order) and order[end] >> PLACE_BITS == pivot:
            end += 1
        ahead = order[end] >> PLACE_BITS if end < len(order) else None
        bound, limit, live = 0, ahead, []
        for key in order[:end]:  # shallow moves
            j = key & PLACE
            lasts, b = lists[j].lasts, block[j]
            if lasts[b] < pivot:
                b = block[j] = bisect_left(lasts, pivot, b)
                if b == len(lasts):
                    continue
            bound += lists[j].impacts[b] * weights[j]
            live.append(j)
            if limit is None or lasts[b] < limit:
                limit = lasts[b] + 1
        if bound <= least:
            if limit is None or not live and ahead is None:
                break
            limit = max(limit, pivot + 1) if live else limit
            order[:end] = [(limit << PLACE_BITS) | j for j in live]
            continue
        score, moved = 0, []
        for j in live:
            b = block[j]
            if read[j] != b:
                docs[j], impacts[j] = lists[j].block(b)
                read[j], at[j] = b, 0
            i = at[j]
            if docs[j][i] < pivot:
                i = at[j] = bisect_left(docs[j], pivot, i)
            if docs[j][i] == pivot:
                score += impacts[j][i] * weights[j]
                if i + 1 < len(docs[j]):
                    at[j] = i + 1
                    moved.append((docs[j][i + 1] << PLACE_BITS) | j)
                elif b + 1 < len(lists[j].lasts):
                    moved.append(((pivot + 1) << PLACE_BITS) | j)
            else:
                moved.append((docs[j][i] << PLACE_BITS) | j)
        order[:end] = moved
        if score > least:
            if len(best) < k:
                heapq.heappush(best, (score, -pivot))
            else:
                heapq.heappushpop(best, (score, -pivot))
            if len(best) == k:
                least = max(least, best[0][0])
    return sorted(((score, -doc) for score, doc in best), key=lambda r: (-r[0], r[1]))


def packed(queries: DataFrame, item_id: str, text: str, pack: int) -> DataFrame:
    """(pack, query, item_id, term, times): every query's terms; a pack has at most `pack` queries and, beyond its first query, PACK_TERMS terms."""
    rows = queries.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = number = TaskContext.get().partitionId() << INDEX_BITS
        queries_held = terms_held = 0
        for batch in pieces(batches, "text"):
            for i, data in enumerate(texts(batch, "text")):
                times: defaultdict[bytes, int] = defaultdict(int)
                for term in terms_of(data):
                    times[term] += 1
                if not times:
                    continue
                if queries_held and (queries_held == pack or terms_held + len(times) > PACK_TERMS):
                    number, queries_held, terms_held = number + 1, 0, 0
                query, queries_held, terms_held = query + 1, queries_held + 1, terms_held + len(times)
                n = len(times)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * n), pa.array([query] * n), batch.column(0).take(pa.array([i] * n)), pa.array(list(times), pa.binary()), pa.array(list(times.values()))],
                    names=["pack", "query", "item_id", "term", "times"],
                )

    kinds = [("pack", T.LongType()), ("query", T.LongType()), ("item_id", rows.schema["item_id"].dataType), ("term", T.BinaryType()), ("times", T.LongType())]
    return materialize(small_batches(rows).mapInArrow(run, T.StructType([T.StructField(*k) for k in kinds])))


def weighted(asked: DataFrame, lists: DataFrame, documents: int) -> DataFrame:
    """asked with each term's weight times its occurrences in the query, those above 0."""
    df = lists.select("term", "n").join(bounded(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    return materialize(asked.join(bounded(df), "term").withColumn("weight", weight * F.col("times")).where(F.col("weight") > 0))


def ask(asked: DataFrame, lists: DataFrame, k: int, floors: DataFrame | None = None) -> DataFrame:
    """(query, doc_id, score): the k best of each shard of `lists` for each query, of at least its floor."""
    known = asked.select("pack", "query", "term", "weight", *([] if floors is not None else [F.lit(0).cast("long").alias("floor")]))
    if floors is not None:
        known = known.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    whole = known.groupBy("pack", "query", "floor").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    whole = whole.groupBy("pack").agg(F.collect_list(F.struct("query", "floor", "terms")).alias("queries"))
    kind = whole.schema["queries"].dataType
    wanted = asked.select("pack", "term").distinct().withColumn("queries", F.lit(None).cast(kind))
    wanted = materialize(wanted.unionByName(whole.withColumn("term", F.lit(NO_TERM))))
    id_type = lists.schema["ids"].dataType.elementType

    def run(rows: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        ids = rows.filter(pc.equal(rows["term"], pa.scalar(NO_TERM, rows["term"].type)))
        names, m, queries = ids["ids"].combine_chunks().flatten(), np.asarray(ids["m"].combine_chunks().flatten()), ids["queries"].to_pylist()[0]
        here = {r["term"]: List(r["lasts"], r["impacts"], r["ends"], r["data"], m) for r in rows.select(["term", "lasts", "impacts", "ends", "data"]).to_pylist() if r["term"] != NO_TERM}
        for query in queries:
            own = [(here[t["term"]], t["weight"]) for t in query["terms"] if t["term"] in here]
            if own:
                best = walk([a for a, _ in own], [w for _, w in own], k, query["floor"])
                found += [(query["query"], doc, score) for score, doc in best]
        columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
        return pa.table([columns[0], names.take(columns[1]), columns[2]], names=["query", "doc_id", "score"])

    met = lists.join(bounded(wanted, 1 << 16), "term").select("pack", *LISTS, "queries")
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    return materialize(met.groupBy("pack", "shard").applyInArrow(run, schema))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", shard_bytes: int = SHARD_BYTES, pack: int = PACK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each query with a score above 0.

    Equal scores go to the smaller doc_id, null ids last. A null or empty text
    has no terms: such a document is never found and such a query finds nothing.
    A repeated document may be found as often as it comes, a repeated query has
    its results as often as it comes. Other columns play no part; empty tables
    give an empty result. `shard_bytes` and `pack` bound a task and change no
    result.
    """
    lists, documents = index(docs, doc_id, text, shard_bytes)
    asked = weighted(packed(queries, item_id, text, pack), lists, documents)
    early = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = ask(asked, lists.where(early), k)
    floors = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    found = found.unionAll(ask(asked, lists.where(~early), k, floors))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("query", "item_id").distinct(), "query").select("item_id", "rank", "doc_id", "score")
