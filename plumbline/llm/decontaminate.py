"""Benchmark passages in documents, by q-gram lemma filtering.

Both sides are taken as UTF-8 with A-Z lower-cased and each run of white space
(space, tab to CR) as one space; a character here is a byte of that. An item of
m characters may differ from a passage by e = floor(rate * m) edits, or fewer
for short items, such that t = m + 1 - q * (e + 1) is at least 1. By the q-gram
lemma a passage within e edits shares at least t q-grams with the item, all on
diagonals (place in the text minus place in the item) that lie within e of each
other. So the different q-grams of an item that a text shares are counted in
overlapping bands of e + 1 diagonals and as many again; only regions whose band
reaches t are kept, and a banded alignment of the whole item settles each of
them. Texts are taken in overlapping chunks and hits a budget at a time, so
memory depends on neither a text's length nor how often it repeats itself.
Items shorter than q are found where they are a document's whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import pieces, small_batches, texts, with_columns

Q = 8  # one 64-bit word
RATE = 0.1
TABLE_BITS = 22
SHARD_BYTES = 4 << 20
CHUNK = 1 << 16  # characters of a text that are looked up at once
BUDGET = 1 << 20  # hits that are expanded at once
KEPT = 1 << 22  # different (item, band, place) of a chunk; beyond that, fewer items are taken at a time
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def normalize(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


@dataclass
class Index:
    """Items of one shard and where their q-grams stand."""

    ids: list
    items: list[bytes]
    edits: np.ndarray  # the budget of each
    least: np.ndarray  # the shared q-grams that the lemma asks for
    grams: np.ndarray  # distinct, sorted
    item: np.ndarray  # of each posting, by gram
    place: np.ndarray
    posting: np.ndarray  # gram number and item of each posting, as one number, in order
    longest: int  # passage of any item, so that no diagonal is below -longest
    table: np.ndarray  # which hash values any gram has
    short: dict[bytes, list[int]]


def _grams(data: np.ndarray) -> np.ndarray:
    n = max(0, len(data) - Q + 1)
    return np.lib.stride_tricks.as_strided(data[: n + Q - 1].view(np.uint8), (n, Q), (1, 1)).copy().view("<u8").ravel() if n else np.zeros(0, "<u8")


def _slot(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def index(rows: list[tuple[object, str | None]], rate: float = RATE) -> Index:
    """Of (item id, text) rows; null and blank items are left out."""
    kept = [(i, normalize(t.encode())) for i, t in rows if t and normalize(t.encode())]
    items = [t for _, t in kept]
    m = np.array([len(t) for t in items], np.int64)
    edits = np.maximum(0, np.minimum((rate * m).astype(np.int64), m // Q - 1))
    grams = [_grams(np.frombuffer(t, np.uint8)) for t in items]
    whole = np.concatenate(grams) if grams else np.zeros(0, "<u8")
    item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
    order = np.argsort(whole, kind="stable")
    distinct, number = np.unique(whole[order], return_inverse=True)
    longest = int(edits.max(initial=0)) + max(map(len, items), default=0) + 1
    table = np.zeros(1 << TABLE_BITS, bool)
    table[_slot(distinct)] = True
    short: dict[bytes, list[int]] = {}
    for n, t in enumerate(items):
        if len(t) < Q:
            short.setdefault(t, []).append(n)
    return Index([i for i, _ in kept], items, edits, m + 1 - Q * (edits + 1), distinct, item[order], place[order], number * len(items) + item[order], longest, table, short)


def _slices(count: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of rows with at most `most` hits in all (a row at least)."""
    ends = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _band_places(found: Index, at: np.ndarray, gram: np.ndarray, low: int, high: int) -> np.ndarray | None:
    """Sorted distinct (item - low, band, place) of the hits of items low to high, each as one number; None if too many.

    Hits are expanded BUDGET at a time, and what they have in common is merged
    after each step, so memory doesn't grow with their number.
    """
    n = len(found.items)
    begin = np.searchsorted(found.posting, gram * n + low)
    count = np.searchsorted(found.posting, gram * n + high) - begin
    merged, parts, held = np.zeros(0, np.int64), [], 0
    for part in _slices(count, BUDGET):
        c = count[part]
        post = np.arange(int(c.sum())) + np.repeat(begin[part] - (np.cumsum(c) - c), c)
        item, place = found.item[post], found.place[post]
        band = (np.repeat(at[part], c) - place + found.longest) // (found.edits[item] + 1)
        parts.append(_distinct((((item - low) << 26) + band) * (found.longest + 1) + place))
        held += len(parts[-1])
        if held > BUDGET:
            merged, parts, held = _distinct(np.concatenate([merged, *parts])), [], 0
            if len(merged) > KEPT and high - low > 1:
                return None
    return _distinct(np.concatenate([merged, *parts]))


def known_grams(found: Index, docs: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(document, places, gram numbers) of the documents with as many known q-grams as any item asks for."""
    if not len(found.grams):
        return
    grams = _grams(np.frombuffer(b"\n".join(docs), np.uint8))  # a line feed is in no item
    at = np.flatnonzero(found.table[_slot(grams)])
    gram = np.minimum(np.searchsorted(found.grams, grams[at]), len(found.grams) - 1)
    real = found.grams[gram] == grams[at]
    at, gram = at[real], gram[real]
    begin = np.cumsum([0] + [len(d) + 1 for d in docs])
    edges = np.searchsorted(at, begin)
    for d in np.flatnonzero(np.diff(edges) >= int(found.least[found.least > 0].min(initial=1 << 40))).tolist():
        mine = slice(edges[d], edges[d + 1])
        yield d, at[mine] - begin[d], gram[mine]


def regions(found: Index, at: np.ndarray, gram: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, first and last diagonal) where two bands side by side hold enough different q-grams of the item.

    Bands that follow each other without a gap are one region.
    """
    todo = [(0, len(found.items))]
    while todo and len(at):
        low, high = todo.pop()
        codes = _band_places(found, at, gram, low, high)
        if codes is None:
            todo += [((low + high) // 2, high), (low, (low + high) // 2)]
            continue
        key, first = np.unique(codes // (found.longest + 1), return_index=True)
        n = np.diff(np.append(first, len(codes)))
        item, follows = (key >> 26) + low, np.append(key[1:] == key[:-1] + 1, False) if len(key) else np.zeros(0, bool)
        after = np.where(follows, np.append(n[1:], 0)[: len(n)], 0)
        good = np.flatnonzero(n + after >= found.least[item])
        ends = np.append(first, len(codes))
        runs: list[list[int]] = []
        for k in good.tolist():
            beside = k + 1 if follows[k] else k
            if n[k] < found.least[item[k]] and n[beside] < found.least[item[k]]:
                place = codes[ends[k] : ends[beside + 1]] % (found.longest + 1)
                if len(np.unique(place)) < found.least[item[k]]:
                    continue
            step = int(found.edits[item[k]]) + 1
            begin = (int(key[k]) & ((1 << 26) - 1)) * step - found.longest
            if runs and runs[-1][0] == item[k] and runs[-1][2] >= begin - 1:
                runs[-1][2] = begin + 2 * step - 1
            else:
                runs.append([int(item[k]), begin, begin + 2 * step - 1])
        yield from map(tuple, runs)


def align(item: bytes, text: bytes, low: int, high: int, most: int, begin: int | None = None) -> tuple[np.ndarray, int]:
    """Fewest edits of the whole item against passages of text on diagonals low to high; those that start at `begin`, if given.

    One number for each diagonal that a passage may end on, and the end on the
    first of them; more than `most` edits count as out of reach. Empty if all are.
    """
    pattern, width = np.frombuffer(item, np.uint8), high - low + 1
    padded = np.zeros(len(item) + width + 1, np.uint8)
    a, b = max(0, low), max(0, min(len(text), low + len(item) + width))
    padded[a - low : a - low + max(0, b - a)] = np.frombuffer(text, np.uint8)[a:b] if b > a else 0
    inside = np.zeros(len(padded), bool)
    inside[a - low : a - low + max(0, b - a)] = True
    far = np.int64(1 << 30)
    spread = np.arange(width)
    starts = low + spread
    row = np.where((starts >= 0) & (starts <= len(text)), 0, far)  # a passage may begin anywhere
    if begin is not None:
        row = np.where(starts >= begin, np.maximum(row, starts - begin), far)
    for i in range(len(pattern)):
        seen, ok = padded[i : i + width], inside[i : i + width]
        new = np.where(ok, row + (seen != pattern[i]), far)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - spread) + spread  # text characters that the item lacks
        row[(starts + i + 1 < 0) | (starts + i + 1 > len(text))] = far
        if row.min() > most:
            return np.zeros(0, np.int64), 0
    return row, low + len(pattern)


def _spans(item: bytes, text: bytes, low: int, high: int, e: int) -> Iterator[tuple[int, int, int]]:
    """(edits, start, end) of the passages in one region: those with the fewest edits first, and of these the first."""
    start = text.find(item, max(0, low - e), max(0, high + e + len(item)))
    if start >= 0 and high - low < 3 * (e + 1):
        yield 0, start, start + len(item)
        return
    row, first = align(item, text, low - e, high + e, e)
    near = np.flatnonzero(row <= e)
    near = near[np.argsort(row[near], kind="stable")]
    while len(near):
        edits, end = int(row[near[0]]), first + int(near[0])
        back = len(text) - end
        behind, reach = align(item[::-1], text[::-1], back - e, back + e, e, begin=back)
        start = len(text) - (reach + int(behind.argmin()))
        yield edits, start, end
        near = near[np.abs(near - near[0]) >= max(1, end - start)]


def _chunks(found: Index, length: int, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(begin, end, first and last known q-gram) of the parts of a text; they share as much as the longest passage has."""
    overlap = 2 * found.longest + 2
    size = max(CHUNK, 2 * overlap)
    for begin in range(0, max(1, length - overlap), size):
        end = min(length, begin + size + overlap)
        yield begin, end, *np.searchsorted(at, [begin, end - Q + 1]).tolist()


def passages(found: Index, docs: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(document, item, start, end, edits) within the edit budget, in normalized characters.

    Of overlapping passages of one item, and of those that end within one's
    length of each other, the one with the fewest edits is kept, then the first.
    """
    kept: dict[tuple[int, int], set] = {}
    for d, text in enumerate(docs):
        for i in found.short.get(text, ()):
            kept[d, i] = {(0, 0, len(text))}
    for d, at, gram in known_grams(found, docs):
        for begin, end, a, b in _chunks(found, len(docs[d]), at):
            part = docs[d][begin:end]
            for i, low, high in regions(found, at[a:b] - begin, gram[a:b]):
                for edits, start, stop in _spans(found.items[i], part, low, high, int(found.edits[i])):
                    kept.setdefault((d, i), set()).add((edits, begin + start, begin + stop))
    rows = []
    for (d, i), spans in sorted(kept.items()):
        taken: list = []
        for edits, start, end in sorted(spans):
            k = bisect_left(taken, (start, end))
            if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= end):
                taken.insert(k, (start, end))
                rows.append((d, i, start, end, edits))
    return rows


def original(text: bytes, places: list[int]) -> list[int]:
    """Places in the normalized text as code points of the text itself."""
    words = [(w.start(), w.end()) for w in _WORD.finditer(text)]
    begins = np.cumsum([0] + [b - a + 1 for a, b in words])
    found = []
    for p in places:
        k = min(int(np.searchsorted(begins, p, "right")) - 1, len(words) - 1)
        found.append(len(text[: min(words[k][0] + p - int(begins[k]), words[k][1])].decode("utf-8", "ignore")))
    return found


def shards(benchmark: DataFrame, rate: float = RATE, size: int = SHARD_BYTES) -> Iterator[Index]:
    """The benchmark in shards of about `size` bytes of text, one at a time: each goes to the tasks."""
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-total // size)
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield index(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1])), rate)


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, item_id, start, end and edits of every passage of every row.

    start and end are code points of the row's own text. Null and empty texts
    have no passage; repeated rows have theirs as often as they come, and an
    item that the benchmark repeats counts once.
    """
    names = list(keep)
    item_type = benchmark.schema["item_id"].dataType
    fields = [T.StructField(n, docs.schema[n].dataType) for n in names]
    schema = T.StructType([*fields, T.StructField("item_id", item_type), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType())])
    source = docs.select(*dict.fromkeys([*names, "text"]))

    def search(found: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text", max_bytes=2 << 20):
                whole = list(texts(batch, "text"))
                rows = passages(found, [normalize(t) for t in whole])
                spans = [original(whole[d], [a, b]) for d, _, a, b, _ in rows]
                new = {
                    "item_id": pa.array([found.ids[r[1]] for r in rows], pa_type),
                    "start": pa.array([s[0] for s in spans], pa.int64()),
                    "end": pa.array([s[1] for s in spans], pa.int64()),
                    "edits": pa.array([r[4] for r in rows], pa.int64()),
                }
                yield with_columns(batch.take(pa.array([r[0] for r in rows], pa.int64())), names, new)

        return source.transform(small_batches).mapInArrow(run, schema)

    pa_type = pa.string() if isinstance(item_type, T.StringType) else pa.int64() if isinstance(item_type, T.LongType) else pa.int32()
    parts = [search(found) for found in shards(benchmark, rate)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of documents, all columns, without a passage of the benchmark."""

    def drop(found: Index, rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text", max_bytes=2 << 20):
                hit = {r[0] for r in passages(found, [normalize(t) for t in texts(batch, "text")])}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        return rows.transform(small_batches).mapInArrow(run, rows.schema)

    for found in shards(benchmark, rate):
        docs = drop(found, docs)
    return docs
