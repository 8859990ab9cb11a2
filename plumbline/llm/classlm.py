"""Class-based bigram language model, with classes from exchange clustering.

Tokens are the words of a text, A-Z lower-cased and cut at ASCII white space,
and one end after the last. Every word that makes up at least `share` of the
training tokens (so at most 1/share words, whatever the corpus) is clustered,
and so is every group of rarer words that share their last two bytes (groups of
at least `group_share` of the tokens; the others are one group). Starting from
classes dealt by frequency, each word or group moves to the class that raises
the class bigrams' mutual information most, half of them at a time, until the
rounds are over. The end is a class of its own.
P(token | previous) = P(class | class of previous) * P(token | class); a rare
word's part is its group's, times its count with one added over the group's,
one unknown type in each group included.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import materialize, pieces, remainder, small_batches, texts, with_columns

END = 0  # token ids: the end, then the groups of rare words (the first is for all small groups), then words
END_WORD = ""  # how the end stands in the table of counts: no word is empty
BUCKETS = 64


@dataclass
class Lexicon:
    """Words with at least the listed share of all tokens, by frequency; the first ones are clustered."""

    words: bytes  # joined by line feeds
    counts: np.ndarray
    clustered: int
    suffixes: list[bytes]  # of the groups of rare words from the second on
    group_tokens: np.ndarray  # of each group: training tokens
    group_types: np.ndarray  # and distinct words

    def places(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.split(b"\n"))} if len(self.counts) else {}

    def groups(self) -> dict[bytes, int]:
        return {x: i + 2 for i, x in enumerate(self.suffixes)}

    @property
    def size(self) -> int:
        return 2 + len(self.suffixes) + self.clustered

    def ids(self) -> np.ndarray:
        """Token id of each listed word."""
        groups = self.groups()
        rare = [groups.get(w[-2:], 1) for w in self.words.split(b"\n")[self.clustered :]] if len(self.counts) > self.clustered else []
        return np.concatenate([np.arange(self.clustered) + 2 + len(self.suffixes), np.array(rare, np.int64)]).astype(np.int64)

    def sizes(self) -> np.ndarray:
        """Count of each token id; groups have one more, for their unknown words; the end is left at 1."""
        return np.concatenate([[1], self.group_tokens + 1, self.counts[: self.clustered]]).astype(float)


@dataclass
class Model:
    lexicon: Lexicon
    classes: np.ndarray  # of each token id
    transitions: np.ndarray  # log10 P(class | class of previous): [previous, class]
    emissions: np.ndarray  # log10 P(token id | class)
    tokens: int
    types: int
    end_count: int
    vocabulary: DataFrame


def count_words(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """(word, n) over all rows, the end included."""

    def out(seen: Counter) -> pa.RecordBatch:
        words = pa.array(list(seen.keys()), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in pieces(batches, "text"):
            for text in texts(batch, "text"):
                seen.update(text.lower().split())
                if len(seen) > flush:
                    yield out(seen)
                    seen = Counter()
            seen[b""] += batch.num_rows
        if seen:
            yield out(seen)

    return docs.select("text").transform(small_batches).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(vocabulary: DataFrame, tokens: int, share: float, listed: float, group_share: float) -> Lexicon:
    """At most 1/listed words and 1/group_share suffixes reach the driver and, as blocks of bytes, the tasks."""
    words = vocabulary.where(F.col("word") != END_WORD)
    rows = words.where(F.col("n") >= max(1.0, listed * tokens)).orderBy(F.desc("n"), "word").collect()
    counts = np.array([r["n"] for r in rows], np.int64)
    least = max(1.0, share * tokens)
    raw = F.col("word").cast("binary")
    groups = words.where(F.col("n") < least).groupBy(F.substring(raw, -2, 2).alias("suffix")).agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    found = groups.where(F.col("n") >= max(1.0, group_share * tokens)).orderBy("suffix").collect()
    whole = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    sums = np.array([[r["n"], r["types"]] for r in found], np.int64).reshape(-1, 2)
    rest = np.array([whole[0], whole[1]], np.int64) - sums.sum(0)
    sums = np.concatenate([rest[None], sums])
    return Lexicon(b"\n".join(r["word"].encode() for r in rows), counts, int((counts >= least).sum()), [bytes(r["suffix"]) for r in found], sums[:, 0], sums[:, 1])


class Reader:
    """Words of a text, their places among the listed words (-1: none), and their token ids."""

    def __init__(self, found: Lexicon):
        self.places, self.groups, self.of = found.places(), found.groups(), found.ids()

    def read(self, text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        words = text.lower().split()
        at = np.array([self.places.get(w, -1) for w in words], np.int64)
        ids = self.of[at] if len(self.of) else np.zeros(len(at), np.int64)
        for i in np.flatnonzero(at < 0).tolist():
            ids[i] = self.groups.get(words[i][-2:], 1)
        return words, at, ids


def count_pairs(docs: DataFrame, found: Lexicon, flush: int = 1 << 22) -> DataFrame:
    """(a, b, n): how often id b follows id a; every text begins behind an end."""
    size = found.size

    def out(parts: list[np.ndarray]) -> pa.RecordBatch:
        stream = np.concatenate([np.array([END]), *parts])
        key, n = np.unique(stream[:-1] * size + stream[1:], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((key // size).astype(np.int32)), pa.array((key % size).astype(np.int32)), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, parts, held = Reader(found), [], 0
        for batch in pieces(batches, "text"):
            for text in texts(batch, "text"):
                ids = reader.read(text)[2]
                parts.append(np.append(ids, END))
                held += len(ids) + 1
                if held > flush:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)

    return docs.select("text").transform(small_batches).mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


# ---- exchange clustering


def class_pairs(pairs: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Counts of class pairs [previous, next]: k * k numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            a, b, n = (np.asarray(c) for c in batch.columns)
            total += np.bincount(classes[a] * k + classes[b], n, k * k).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    found = np.zeros(k * k, np.int64)
    for r in pairs.select("a", "b", "n").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        found[r["i"]] = r["n"]
    return found.reshape(k, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def information(m: np.ndarray) -> float:
    """The part of the log-likelihood that the classes decide."""
    m = m.astype(float)
    return float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum())


def best_classes(m: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the class 1..k-1 where it adds most, and the gain over its own.

    right, left: (words, k) counts of the next and the previous token's class.
    """
    m = m.astype(float)
    best, gain = own.copy(), np.zeros(len(own))
    for c in np.unique(own):
        at = np.flatnonzero(own == c)
        for i in range(0, len(at), 512):
            w = at[i : i + 512]
            r, s = right[w].astype(float), left[w].astype(float)
            base = np.repeat(m[None], len(w), 0)  # without the word itself
            base[:, c, :] = np.maximum(base[:, c, :] - r, 0)
            base[:, :, c] = np.maximum(base[:, :, c] - s, 0)
            rows, cols = base.sum(2), base.sum(1)
            added = (_xlogx(base + r[:, None, :]) - _xlogx(base)).sum(2) + (_xlogx(base + s[:, :, None]) - _xlogx(base)).sum(1)
            added -= _xlogx(rows + r.sum(1)[:, None]) - _xlogx(rows) + _xlogx(cols + s.sum(1)[:, None]) - _xlogx(cols)
            added[:, END] = -np.inf
            top = added.argmax(1)
            best[w], gain[w] = top, added[np.arange(len(w)), top] - added[:, c]
    return best, gain


def exchange(pairs: DataFrame, sizes: np.ndarray, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token id, and the class pairs' counts."""
    k = classes + 1
    now = np.zeros(len(sizes), np.int64)
    now[1 + np.argsort(-sizes[1:], kind="stable")] = 1 + np.arange(len(sizes) - 1) % classes
    m = class_pairs(pairs, now, k)
    sides = [pairs.select(F.col(w).alias("word"), F.lit(side).alias("side"), F.col(o).alias("other"), "n") for side, w, o in ((0, "a", "b"), (1, "b", "a"))]
    both = sides[0].unionAll(sides[1]).where(F.col("word") != END).withColumn("bucket", F.col("word") % BUCKETS)
    both = materialize(both.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "word"))
    best = (information(m), now, m)
    for step in range(rounds):
        moved = _moves(both, now, m, k, step % 2).collect()
        if not moved and step:
            break
        now = now.copy()
        for r in moved:
            now[r["word"]] = r["best"]
        m = class_pairs(pairs, now, k)
        if information(m) > best[0]:
            best = (information(m), now, m)
    return best[1], best[2]


def _moves(both: DataFrame, now: np.ndarray, m: np.ndarray, k: int, half: int) -> DataFrame:
    """(word, best) for the words of one half that gain by moving; one row a clustered word at most."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, side, other, n = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("word", "side", "other", "n"))
            keys, at = np.unique(word, return_inverse=True)
            sums = np.bincount(at * 2 * k + side * k + now[other], n, len(keys) * 2 * k).astype(np.int64).reshape(len(keys), -1)
            yield pa.RecordBatch.from_arrays([pa.array(keys % BUCKETS, pa.int32()), pa.array(keys, pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], names=["bucket", "word", "sums"])

    def choose(group: pa.Table) -> pa.Table:
        words = np.asarray(group.column("word").combine_chunks())
        sums = np.frombuffer(b"".join(group.column("sums").to_pylist()), np.int64).reshape(len(words), 2 * k)
        keys, at = np.unique(words, return_inverse=True)
        total = np.zeros((len(keys), 2 * k), np.int64)
        np.add.at(total, at, sums)
        best, gain = best_classes(m, total[:, :k], total[:, k:], now[keys], k)
        use = gain > 1e-6
        return pa.table({"word": pa.array(keys[use], pa.int32()), "best": pa.array(best[use].astype(np.int32))})

    turn = both.where(F.floor(F.col("word") / BUCKETS) % 2 == half)
    return turn.mapInArrow(gather, "bucket int, word int, sums binary").groupBy("bucket").applyInArrow(choose, "word int, best int")


# ---- model and scores


def learn(docs: DataFrame, share: float = 1e-5, listed: float = 1e-6, group_share: float = 1e-4, classes: int = 32, rounds: int = 6, smooth: float = 1.0) -> Model:
    """Fit on all rows of docs."""
    vocabulary = materialize(count_words(docs))
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END_WORD, F.col("n"))), F.lit(0))).first()
    tokens, types, ends = int(total[0]), int(total[1]), int(total[2])
    found = lexicon(vocabulary, tokens, share, listed, group_share)
    sizes = found.sizes()
    of, m = exchange(materialize(count_pairs(docs, found)), sizes, classes, rounds)
    k = classes + 1
    prior = (m.sum(0) + 1.0) / (m.sum() + k)
    transitions = np.log10((m + smooth * prior[None, :]) / (m.sum(1) + smooth)[:, None])
    return Model(found, of, transitions, np.log10(sizes / np.bincount(of, sizes, k)[of]), tokens, types, ends, vocabulary)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row.

    base_score: the log10 probability of the text by single counts with one
    added; score: by the model; perplexity: 10 ** (-score / n_tokens). A null
    text is an empty one, which is just an end. Words that aren't listed in the
    lexicon meet their counts in a join; none of them is frequent.
    """
    found, floor = model.lexicon, float(np.log10(model.tokens + model.types + 1))
    counts = np.append(found.counts, 0).astype(float)
    base = np.log10(counts + 1) - floor  # the last one is for words that aren't listed
    within = np.where(np.arange(len(counts)) < found.clustered, 0.0, np.log10(counts + 1))
    emit = model.emissions.copy()  # for a rare word, less its group's total
    groups = len(found.group_tokens)
    emit[1 : 1 + groups] -= np.log10(found.group_tokens + found.group_types + 1)
    end_base = float(np.log10(model.end_count + 1)) - floor
    classes, transitions, ended = model.classes, model.transitions, model.end_count > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(found)
        for batch in pieces(batches, "text", max_bytes=8 << 20):
            rows = [reader.read(t) for t in texts(batch, "text")]
            n = np.array([len(at) + 1 for _, at, _ in rows])
            begin = np.cumsum(n) - n
            ids = np.concatenate([[END], *(np.append(x, END) for _, _, x in rows)])
            step = transitions[classes[ids[:-1]], classes[ids[1:]]] + emit[ids[1:]]
            step += np.concatenate([np.append(within[at], 0.0) for _, at, _ in rows])
            single = np.concatenate([np.append(base[at], end_base) for _, at, _ in rows])
            known = np.concatenate([np.append(at >= 0, ended) for _, at, _ in rows]).astype(np.int64)
            rare = [Counter(words[i] for i in np.flatnonzero(at < 0).tolist()) for words, at, _ in rows]
            new = {
                "n_tokens": pa.array(n),
                "n_known": pa.array(np.add.reduceat(known, begin)),
                "base_score": pa.array(np.add.reduceat(single, begin)),
                "score": pa.array(np.add.reduceat(step, begin)),
                "rare": pa.array([list(r) for r in rare], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                "times": pa.array([list(r.values()) for r in rare], pa.list_(pa.int64())),
            }
            yield with_columns(batch, ["doc_id", "row"], new)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("row", T.LongType())] + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")] + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")])
    schema = schema.add("rare", T.ArrayType(T.StringType())).add("times", T.ArrayType(T.LongType()))
    rows = materialize(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).transform(small_batches).mapInArrow(run, schema))
    each = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    least = float(found.counts.min()) if len(found.counts) else float("inf")
    tail = model.vocabulary.where((F.col("word") != END_WORD) & (F.col("n") < least))
    met = each.join(tail, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"))
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    whole = rows.drop("rare", "times").join(met, "row", "left")
    return whole.select("doc_id", "n_tokens", add("n_known", "more_known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), add("base_score", "more").alias("base_score"), add("score", "more").alias("score")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def predict(docs: DataFrame, fold: int = 7, out: int = 2, **settings) -> DataFrame:
    """Scores of all rows by a model of those whose crc32(doc_id) mod `fold` isn't `out`."""
    model = learn(docs.where(remainder(F.col("doc_id"), fold) != out), **settings)
    held = (remainder(F.col("doc_id"), fold) == out).alias("held_out")
    return score(docs, model).select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
