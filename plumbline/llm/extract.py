"""Main text of web pages, from a suffix array over each host's pages.

A page becomes blocks of text; a block's zone is the path of its last block
elements with their first class or id. Consecutive blocks of one zone are a
segment, and the words of all segments of a host's pages are one stream, in
which nothing repeats over the end of a segment. A suffix array, sorted by
prefix doubling as deep as a run is long, shows which runs of `length` words
stand on two pages or more (a shorter segment is one run). Pages whose longest
block is the same, copies of one article, count as one page.

What the runs decide:

- a zone of a host most of whose runs repeat across its pages is boilerplate,
  also where one page's text in it is unique; one that hardly repeats is none,
  whatever its name; a host with few pages, or with a share that says neither,
  takes the zone's share over all hosts;
- in text that no element marks as content or as furniture, words covered by
  repeated runs go and the unique runs stay.

Names of elements and classes decide where the runs say neither: then text in a
menu, footer, sidebar, form or advert goes. A class is such a name only as a
whole: every part of it has to be one, so that `related-work` and `share-prices`
are none, and the class of a paragraph or heading never is. Names alone tell
reader comments, which are unique like articles. Repeated text in the
undecorated paragraphs of an article is a copied passage and stays; and beside
an article, all else goes.

Hosts with much text are dealt to shards; each has a suffix array of its own.
Zones' shares are summed over the shards, runs of unmarked text are counted
over them. Only the streams, packed, are shuffled; the pages are parsed once
more where they are read.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import materialize, pieces, small_batches, texts, with_columns

LENGTH = 8
#: Zones by their names: content, furniture named inside of content, neither, furniture, reader comments.
CONTENT, INNER, OPEN, FURNITURE, COMMENTS = 3, 2, 1, 0, -1
NAME = re.compile(r"[a-zA-Z][^\s/><]*")
QUOTED = re.compile(r"=\s*([\"'])")
#: Elements whose text nobody reads, up to their end tag.
SILENT = set("script style noscript template svg iframe object canvas head textarea select option audio video button".split())
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
ASIDE = set("nav footer aside form menu dialog fieldset".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul head".split()
)
HEAD = {"title", "meta", "link", "style", "script", "base", "noscript", "template"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
CLOSES = set("p li td th tr dd dt".split())  # a new one ends an open one of its kind
SCOPE = set("article main div section ul ol table dl body blockquote".split())  # but not one outside of these
#: Words in class, id and role that mark furniture anywhere, or outside of content only, or content.
STRONG = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login "
    "comment comments disqus respond replies reply sidebar widget nav navbar navigation menubar breadcrumb breadcrumbs crumbs share sharing social related recommended recommendations "
    "pagination pager masthead contentinfo complementary search form".split()
)
WEAK = set("banner notice notices alert side menu footer foot header toolbar tags copyright legal disclaimer dialog".split())
GOOD = set("content article post entry main story text body".split())
#: Words that say nothing of what they are part of.
PLAIN = set(
    "box bar bars list lists item items link links button buttons block wrap wrapper container area section inner outer top bottom left right panel col row icon icons slot unit module "
    "post posts article articles story stories page site main global mobile desktop sticky title heading header head text body content count thread form id".split()
)
#: Elements that hold the text itself; their classes name what it says, not where it stands.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 pre blockquote li td th dd dt figcaption address summary caption".split())
COMMENT = {"comment", "comments", "reply", "replies", "disqus", "respond"}
LABEL = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PART = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

Block = tuple[str, int, str, bool]


def _places(mark: str, page: str) -> list[int]:
    return [m.start() for m in re.finditer(re.escape(mark), page)]


class _Tags:
    """Where tags end, found in about linear time on any text."""

    def __init__(self, page: str):
        self.page, self.ends, self.quotes, self.plain = page, _places(">", page), {}, False

    def after(self, places: list[int], at: int) -> int:
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def end(self, at: int) -> int:
        """Place of the `>` that ends a tag whose name ends at `at`, or -1.

        Quoted values may hold one, unless the quote isn't closed: then no
        space, slash or `>` follows the next quote, and the tag ends at its
        first `>`.
        """
        while True:
            end = self.after(self.ends, at)
            if end < 0:
                self.plain = True  # from here on tags end at their first `>`
                return end
            value = None if self.plain else QUOTED.search(self.page, at, end)
            if value is None:
                return end
            mark = value[1]
            if mark not in self.quotes:
                self.quotes[mark] = _places(mark, self.page)
            close = self.after(self.quotes[mark], value.end())
            if close < 0 or close > end and self.page[close + 1 : close + 2].strip(" \t\r\n\f/>"):
                return end
            at = close + 1


class _Open:
    """The open elements. Each knows its prior zone, its path, and what becomes of its text."""

    def __init__(self):
        self.stack: list[tuple] = []
        self.at: dict[str, list[int]] = {}  # places of each name in the stack
        self.scopes: list[int] = []

    def push(self, name: str, frame: tuple) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append((name, *frame))

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            name = self.stack.pop()[0]
            self.at[name].pop()
            if name in SCOPE:
                self.scopes.pop()

    def close(self, name: str, within: bool = False) -> None:
        """Ends the innermost open element of this name, and all inside it; `within`: unless a scope lies between."""
        if self.at.get(name) and not (within and self.scopes and self.scopes[-1] > self.at[name][-1]):
            self.cut(self.at[name][-1])


@lru_cache(1 << 14)
def _telling(name: str) -> frozenset[str]:
    """The words of one class, id or role that say what it is, if all that say something say the same."""
    parts = frozenset(PART.findall(name))
    telling = parts - PLAIN or parts
    return telling if any(telling <= kind for kind in (STRONG, WEAK, COMMENT, GOOD)) else frozenset()


def _labels(attributes: str) -> tuple[set[str], str]:
    """The words of class, id and role whose name they make up whole; and the first class or id itself, without digits.

    A name in several parts counts by those that say something, if each of them
    is a word for furniture, comments or content.
    """
    words: set[str] = set()
    first = ""
    for found in LABEL.finditer(attributes):
        value = (found[2] or found[3] or found[4] or "").lower()
        for name in value.split():
            words |= _telling(name)
        if found[1].lower() == "role" and value.strip() == "main":
            words.add("role=main")
        if not first and found[1].lower() != "role":
            first = re.sub(r"[\d/]+", "", value.split()[0] if value.split() else "")[:32]
    return words, first


def _prior(name: str, words: set[str], above: int) -> int:
    """The zone that names alone would give."""
    if above == COMMENTS:
        return above
    if name == "main" and not words & COMMENT:
        return CONTENT
    if words & COMMENT and name not in TEXTUAL:
        return COMMENTS
    if above in (FURNITURE, INNER) or name in ("body", "html"):
        return above
    furniture = INNER if above == CONTENT else FURNITURE
    if name in ASIDE:
        return furniture
    if name == "article":
        return CONTENT
    if name == "header" and above != CONTENT:
        return furniture
    if name not in TEXTUAL and not words & GOOD and (words & STRONG or above == OPEN and words & WEAK):
        return furniture
    return CONTENT if "role=main" in words else above


def blocks(page: str) -> list[Block]:
    """(text, prior zone, path, decorated) of every block with text, in page order.

    Markup needn't be sound: unclosed elements end with the one around them,
    stray end tags are nothing, and a `<` that opens no tag is text. Inline
    elements named as furniture lose their own text only. decorated: a class or
    id stands on the path below the content element.
    """
    found: list[Block] = []
    tags, opened = _Tags(page), _Open()
    held: list[str] = []
    root = ("", OPEN, (), False, False, False)  # name, zone, path, decorated, dropped, silent
    at = 0

    def top() -> tuple:
        return opened.stack[-1] if opened.stack else root

    def text(a: int, b: int) -> None:
        if b > a and not (top()[4] or top()[5]):
            held.append(page[a:b])

    def flush() -> None:
        if held:
            whole = SPACE.sub(" ", html.unescape("".join(held))).strip()
            if whole:
                _, zone, path, decorated, _, _ = top()
                found.append((whole, zone, "/".join(path), decorated))
            held.clear()

    last = tags.ends[-1] if tags.ends else -1
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            text(at, len(page))
            break
        if page.startswith("<!--", lt):
            text(at, lt)
            end = page.find("-->", lt + 2)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith("<![CDATA[", lt):
            text(at, lt)
            end = page.find("]]>", lt)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[lt + 1] in "!?":
            text(at, lt)
            at = tags.after(tags.ends, lt) + 1
            continue
        closing = page[lt + 1] == "/"
        named = NAME.match(page, lt + 1 + closing)
        end = tags.end(named.end()) if named else -1
        if end < 0:
            text(at, lt + 1)
            at = lt + 1
            continue
        text(at, lt)
        at = end + 1
        name = named[0].lower()
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if closing:
            opened.close(name)
            continue
        if top()[0] == "head" and name not in HEAD:
            opened.cut(len(opened.stack) - 1)  # its end tag is missing
        if name in RAW:
            close = RAW[name].search(page, at)
            at = close.end() if close else len(page)
            continue
        attributes = page[named.end() : end]
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name in CLOSES:
            opened.close(name, within=True)
        _, zone, path, decorated, dropped, silent = top()
        words, first = _labels(attributes) if "=" in attributes else (set(), "")
        if name in BLOCKS:
            inside = zone == CONTENT
            if dropped and top()[0] == "span":
                dropped = False
            zone = _prior(name, words, zone)
            path = (*path[-3:], f"{name}.{first}" if first else name)
            decorated = inside and zone == CONTENT and (decorated or bool(first))
        elif words & STRONG and not words & GOOD:
            dropped = True
        opened.push(name, (zone, path, decorated, dropped, silent or name in SILENT))
    flush()
    return found


def host_of(url: Column) -> Column:
    """The host a URL names, lower-cased; empty where it names none."""
    pattern = r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1))


# ---- repeated runs


def suffix_ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first tokens, by prefix doubling until they are `length` at least; equal ranks are equal runs.

    `length` is a power of two; behind the end every token counts as its own.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < length:
        behind = np.full(len(rank), -1, np.int64)
        behind[:-step] = rank[step:] if step < len(rank) else []
        key = rank * (len(rank) + 2) + behind + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return rank


def _hash(text: str) -> int:
    """64 bits, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(text)).view(np.int64))


def run_hash(words: list[str]) -> int:
    return _hash(" ".join(words))


def zone_hash(path: str) -> int:
    return _hash("zone\0" + path)


def cleared_hash(path: str) -> int:
    """Of a zone that hardly repeats."""
    return ~zone_hash(path)


def segments(page: list[Block]) -> list[tuple[str, bool, list[str], list[int]]]:
    """(path, unmarked, lower-cased words, words of each block) of the page's segments.

    Text is unmarked on a page without content, in a zone that names leave open.
    """
    article = any(b[1] == CONTENT for b in page)
    found: list[tuple[str, bool, list[str], list[int]]] = []
    for text, zone, path, _ in page:
        words = text.lower().split()
        if not found or found[-1][0] != path:
            found.append((path, zone == OPEN and not article, [], []))
        found[-1][2].extend(words)
        found[-1][3].append(len(words))
    return found


def page_key(page: list[Block]) -> int:
    """Hash of the longest block, of those in content if there are any: copies of an article have the same."""
    chosen = [b[0] for b in page if b[1] == CONTENT] or [b[0] for b in page]
    return _hash(max(chosen, key=lambda t: (len(t), t), default=""))


def shard_runs(pages: list[tuple[int, list]], length: int = LENGTH) -> tuple[list[tuple[str, int, int, int]], list[tuple[int, int, int]]]:
    """From the suffix array of one shard's pages (key, segments):

    (path, pages, runs, repeated runs) of every zone, and (hash, smallest and
    largest page key) of every run of unmarked text. A run repeats if two pages
    of different keys have it; of pages with one key just one is given.
    """
    vocabulary: dict[str, int] = {}
    paths: dict[str, int] = {}
    ids: list[int] = []
    stream: list[str | None] = []
    rows = []  # of each segment: first token, words, path, page, unmarked
    for number, (_, found) in enumerate(pages):
        for path, unmarked, words, _ in found:
            rows.append((len(ids), len(words), paths.setdefault(path, len(paths)), number, unmarked))
            ids += [vocabulary.setdefault(w, len(vocabulary)) for w in words] + [-1] * length
            stream += words + [None] * length
    if not rows:
        return [], []
    begin, size, path, page, unmarked = np.array(rows, np.int64).T
    rank = suffix_ranks(np.array(ids, np.int64), length)
    starts = np.maximum(1, size - length + 1)  # a short segment is one run
    segment = np.repeat(np.arange(len(rows)), starts)
    at = begin[segment] + np.arange(len(segment)) - np.repeat(np.cumsum(starts) - starts, starts)
    run, n_runs = rank[at], int(rank.max()) + 1
    keys = np.array([k for k, _ in pages], np.int64)
    least, most = np.full(n_runs, np.iinfo(np.int64).max), np.full(n_runs, np.iinfo(np.int64).min)
    np.minimum.at(least, run, keys[page[segment]])
    np.maximum.at(most, run, keys[page[segment]])
    repeated = (least < most)[run]
    total = np.bincount(path[segment], minlength=len(paths))
    twice = np.bincount(path[segment], weights=repeated, minlength=len(paths)).astype(np.int64)
    n_pages = np.bincount(np.unique(path * len(pages) + page) // len(pages), minlength=len(paths))
    zones = [(p, int(n_pages[i]), int(total[i]), int(twice[i])) for p, i in paths.items()]
    open_at = at[unmarked[segment] == 1]
    _, first = np.unique(rank[open_at], return_index=True)
    ends = begin + size
    found_runs = []
    for i, s in zip(open_at[first].tolist(), segment[unmarked[segment] == 1][first].tolist()):
        found_runs.append((run_hash(stream[i : min(i + length, int(ends[s]))]), int(least[rank[i]]), int(most[rank[i]])))
    return zones, found_runs


def page_items(page: list[Block], length: int = LENGTH) -> set[int]:
    """Hashes of all that could be known of a page: its zones, and the runs of its unmarked text."""
    found = {h(b[2]) for b in page for h in (zone_hash, cleared_hash)}
    for _, unmarked, words, _ in segments(page):
        if unmarked:
            found.update(run_hash(words[i : i + length]) for i in range(max(1, len(words) - length + 1)))
    return found


def _long_parts(mark: np.ndarray, length: int) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a < min(length, len(mark)):
            mark[a:b] = False
    return mark


def covered(page: list[Block], known, length: int = LENGTH) -> list[np.ndarray | None]:  # noqa: ANN001
    """For each block of unmarked text, which of its words boilerplate covers.

    Fewer than `length` words at a block's edge, which a run over two blocks
    reaches, don't count unless they are the whole block.
    """
    marks: list[np.ndarray | None] = []
    for _, unmarked, words, sizes in segments(page):
        if not unmarked:
            marks += [None] * len(sizes)
            continue
        edge = np.zeros(len(words) + 1, np.int64)
        for i in range(max(1, len(words) - length + 1)):
            if run_hash(words[i : i + length]) in known:
                edge[i] += 1
                edge[min(i + length, len(words))] -= 1
        mark = np.cumsum(edge[:-1]) > 0
        ends = np.cumsum(sizes)
        marks += [_long_parts(mark[b - n : b].copy(), length) for b, n in zip(ends.tolist(), sizes)]
    return marks


def main_text(page: list[Block], known, length: int = LENGTH) -> str:  # noqa: ANN001
    """The blocks that stay, joined by empty lines. known: hashes of the host's boilerplate zones and runs, and of its zones that are none."""
    article = any(b[1] == CONTENT for b in page)
    marks = [None] * len(page) if article else covered(page, known, length)
    kept = []
    for (text, zone, path, decorated), mark in zip(page, marks):
        if zone == COMMENTS or article and zone in (OPEN, FURNITURE):
            continue
        if zone_hash(path) in known and not (zone == CONTENT and not decorated):
            # an unmarked zone without class or id may hold both: there each run counts
            if zone != OPEN or "." in path:
                continue
        elif zone in (FURNITURE, INNER) and cleared_hash(path) not in known:
            continue
        if mark is None or not mark.any():
            kept.append(text)
        elif not mark.all():
            kept.append(" ".join(w for w, m in zip(text.split(), mark) if not m))
    return "\n\n".join(kept)


# ---- Spark

STREAM_BYTES = 8 << 20
KNOWN_ITEMS = 1 << 20


def pack_streams(pages: list[tuple[int, int, list]]) -> bytes:
    """(signature, key, segments) of pages of one shard, compressed together."""
    return zstandard.compress(json.dumps(pages, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 3)


def unpack_streams(packed: list[bytes]) -> list[tuple[int, list]]:
    """(key, segments) of a shard's pages, one of each key: that with the smallest signature."""
    pages: dict[int, tuple[int, list]] = {}
    for blob in packed:
        for signature, key, found in json.loads(zstandard.decompress(blob)):
            if key not in pages or signature < pages[key][0]:
                pages[key] = (signature, [(p, u, w.split(" "), None) for p, u, w in found])
    return [(key, pages[key][1]) for key in sorted(pages)]


def streams(pages: DataFrame, shard_bytes: int) -> DataFrame:
    """(host, shard, packed): the token streams of all pages, each task's copies of a page once."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.octet_length("html").alias("size"))
    large = materialize(hosts.groupBy("host").agg(F.ceil(F.sum("size") / shard_bytes).cast("int").alias("shards")).where("shards > 1"))
    few = large.count() <= KNOWN_ITEMS // 16
    dealt = pages.select(host_of(F.col("url")).alias("host"), "html").join(F.broadcast(large) if few else large, "host", "left").select("host", F.coalesce("shards", F.lit(1)).alias("shards"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        held: dict[tuple[str, int], list] = {}
        size = 0

        def packed() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([pack_streams(held[k]) for k in keys], pa.binary())], names=["host", "shard", "packed"])

        for batch in pieces(batches, "html", max_bytes=4 << 20, max_rows=512):
            hosts, shards = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("host", "shards"))
            for host, n, raw in zip(hosts, shards, texts(batch, "html")):
                found = blocks(raw.decode("utf-8", "replace"))
                signature = _hash("\0".join(b[0] for b in found))
                if (host, signature) in seen:
                    continue
                seen.add((host, signature))
                parts = [(path, unmarked, " ".join(words)) for path, unmarked, words, _ in segments(found)]
                held.setdefault((host, signature % n), []).append((signature, page_key(found), parts))
                size += sum(len(b[0]) for b in found) + 64
                if size > STREAM_BYTES:
                    yield packed()
                    held, size = {}, 0
        if held:
            yield packed()

    return dealt.transform(small_batches).mapInArrow(run, "host string, shard int, packed binary")


EVIDENCE = "host string, path string, item long, pages long, runs long, repeated long, low long, high long"


def evidence(pages: DataFrame, length: int = LENGTH, shard_bytes: int = 4 << 20) -> DataFrame:
    """What the shards' suffix arrays say of zones (path is set) and of runs of unmarked text; written once."""

    def gather(group: pa.Table) -> pa.Table:
        zones, runs = shard_runs(unpack_streams(group.column("packed").to_pylist()), length)
        host = group.column("host")[0].as_py()
        n, m = len(zones), len(runs)
        counts = [pa.array([z[i] for z in zones] + [None] * m, pa.int64()) for i in (1, 2, 3)]
        keys = [pa.array([None] * n + [r[i] for r in runs], pa.int64()) for i in (1, 2)]
        items = pa.array([zone_hash(z[0]) for z in zones] + [r[0] for r in runs], pa.int64())
        return pa.table([pa.array([host] * (n + m), pa.string()), pa.array([z[0] for z in zones] + [None] * m, pa.string()), items, *counts, *keys], names=[f.split()[0] for f in EVIDENCE.split(", ")])

    return materialize(streams(pages, shard_bytes).groupBy("host", "shard").applyInArrow(gather, EVIDENCE))


def boilerplate(found: DataFrame, share: float = 0.5, clear: float = 0.1, few: int = 8) -> DataFrame:
    """(host, item): what the evidence says of the host's zones, boilerplate or cleared, and its repeated runs.

    A host with `few` pages or more in a zone decides by itself if `share` of
    the zone's runs repeat, or less than `clear` of them; else the zone's share
    over all hosts with as many pages decides, by the same bounds. Of a zone
    between them nothing is said.
    """
    zones = found.where("path is not null").groupBy("host", "path", "item").agg(*[F.sum(c).alias(c) for c in ("pages", "runs", "repeated")])
    enough = F.col("pages") >= few
    everywhere = zones.where(enough).groupBy("path").agg((F.sum("repeated") / F.sum("runs")).alias("pooled"))
    own = F.when(enough, F.col("repeated") / F.col("runs"))
    decided = F.coalesce(F.when((own >= share) | (own < clear), own), "pooled")
    item = F.when(decided >= share, F.col("item")).when(decided < clear, F.bitwise_not("item"))
    judged = zones.join(everywhere, "path", "left").select("host", item.alias("item")).where("item is not null")
    runs = found.where("path is null").groupBy("host", "item").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    return judged.unionAll(runs.select("host", "item"))


def _page_id(column: str = "html") -> list[Column]:
    return [F.xxhash64(column).alias("_a"), F.xxhash64(F.lit(7), F.col(column)).alias("_b")]


def known_of_pages(pages: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """(_a, _b, host, known): of each different page (by two hashes) those of its own zones and runs that are boilerplate.

    A list is as long as a page at most, however much is known of the host.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", max_bytes=4 << 20, max_rows=512):
            at, found = [], []
            for i, raw in enumerate(texts(batch, "html")):
                own = page_items(blocks(raw.decode("utf-8", "replace")), length)
                at += [i] * len(own)
                found += own
            yield with_columns(batch.take(pa.array(at, pa.int64())), ["_a", "_b", "host"], {"item": pa.array(found, pa.int64())})

    own = pages.select(*_page_id(), "host", "html").transform(small_batches).mapInArrow(run, "_a long, _b long, host string, item long")
    return own.distinct().join(items, ["host", "item"]).groupBy("_a", "_b", "host").agg(F.collect_set("item").alias("known"))


def extract(pages: DataFrame, length: int = LENGTH, shard_bytes: int = 4 << 20, share: float = 0.5, clear: float = 0.1, few: int = 8, known_items: int = KNOWN_ITEMS) -> DataFrame:
    """page_id, url, text, n_chars for every page; text is empty where nothing is left.

    Pages without a host share one. Repeated pages come back as often as they
    come. A null html is empty. Extra columns play no part; an empty table
    gives an empty result. Up to `known_items` boilerplate zones and runs go to
    all tasks; if there are more, each page is joined to its own, with the same
    result.
    """
    items = materialize(boilerplate(evidence(pages, length, shard_bytes), share, clear, few))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    everywhere = None
    if items.count() <= known_items:
        table = items.toArrow().sort_by("host")
        names, at = np.unique(np.array(table.column("host").to_pylist(), object).astype(str), return_index=True)
        parts = np.split(table.column("item").to_numpy().astype(np.int64), at[1:])
        everywhere = pages.sparkSession.sparkContext.broadcast(dict(zip(names.tolist(), parts)))
    else:
        known = materialize(known_of_pages(rows, items, length))
        rows = rows.select("*", *_page_id()).join(known, ["_a", "_b", "host"], "left").select("page_id", "url", "html", "host", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(64)
        def of_host(host: str) -> frozenset[int]:
            return frozenset(everywhere.value.get(host, np.zeros(0, np.int64)).tolist())

        for batch in pieces(batches, "html", max_bytes=4 << 20, max_rows=512):
            found = []
            hosts = batch.column(batch.schema.get_field_index("host")).to_pylist()
            for i, (host, raw) in enumerate(zip(hosts, texts(batch, "html"))):
                of_page = of_host(host) if everywhere is not None else set(batch.column(batch.schema.get_field_index("known"))[i].as_py() or ())
                found.append(main_text(blocks(raw.decode("utf-8", "replace")), of_page, length))
            yield with_columns(batch, ["page_id", "url"], {"text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())})

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.transform(small_batches).mapInArrow(run, schema)
