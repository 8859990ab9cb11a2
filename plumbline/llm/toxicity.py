"""Toxicity by weak supervision.

Voters are lexicons, patterns and terms: a term voter fires on a word, or on a
word's first four, five or six letters, that a bounded sample of labelled
training rows sets apart. A generative label model then explains the votes of
all documents by one hidden class: expectation maximization estimates how often
each voter fires in either class and how voters go together within a class;
voters that repeat each other share their weight. A linear classifier is
trained on the model's posterior labels and scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import materialize, pieces, remainder, small_batches, texts, with_columns

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)

#: Seed lexicons, each a voter: common insults by language and by what they are aimed at.
LEXICONS = [
    "idiot idiots moron morons imbecile stupid dumb fool fools dimwit halfwit",
    "loser losers worthless pathetic useless failure nobody",
    "scum trash garbage filth vermin parasite parasites rat rats",
    "disgusting revolting repulsive ugly gross",
    "creep jerk bastard clown coward liar hypocrite",
    "idiot idioten trottel dummkopf depp schwachkopf",
    "abschaum versager nichtsnutz ungeziefer missgeburt",
    "arschloch drecksack mistkerl hurensohn",
    "widerlich ekelhaft abstoßend jämmerlich erbärmlich",
    "idiot imbécile crétin débile abruti",
    "connard salaud enfoiré ordure",
    "minable pathétique dégoûtant répugnant",
    "vermine parasite déchet racaille",
    "idiota imbécil estúpido tonto bobo",
    "cabrón escoria basura parásito",
    "asqueroso repugnante patético inútil",
]
#: Phrases, each list a voter.
PHRASES = [
    ["shut up", "get lost", "go away", "piss off"],
    ["go to hell", "drop dead", "kill yourself", "nobody likes you", "hate you", "hope you die", "hope you fail", "hope you suffer"],
    ["halt die klappe", "halt's maul", "verpiss dich", "hau ab"],
    ["ich hasse dich", "geh sterben", "fahr zur hölle"],
    ["ta gueule", "ferme-la", "va te faire", "casse-toi"],
    ["je te déteste", "va mourir", "va en enfer"],
    ["cállate", "lárgate", "vete al infierno", "vete al diablo"],
    ["te odio", "muérete"],
]
_INSULT = "|".join(sorted({w for v in LEXICONS for w in v.split()}))
#: Patterns around an insult, each a voter; looked for where a lexicon fires.
ADDRESSED = [
    rf"\byou(?:'re| are)? (?:a |an |all |such |so |just )*(?:{_INSULT})\b",
    rf"\b(?:du|sie|ihr) (?:bist|sind|seid)? ?(?:ein |eine |so |nur )*(?:{_INSULT})\b",
    rf"\b(?:tu es|vous êtes|t'es) (?:un |une |des |si |trop )*(?:{_INSULT})\b",
    rf"\b(?:eres|sois|son) (?:un |una |unos |tan )*(?:{_INSULT})\b",
    rf"\b(?:{_INSULT})\b.{{0,40}}\b(?:{_INSULT})\b",
    rf"\b(?:{_INSULT})\s*!",
]
#: Patterns of tone on the text as it is, each a voter.
TONE = [r"!{3,}", r"(?:\b[A-Z]{4,}\b[^\w]+){4}"]
FIXED = len(LEXICONS) + len(PHRASES) + len(ADDRESSED) + len(TONE)
MAX_VOTERS = 60


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)  # a word, or its first letters and "*"
    votes: list[str] = field(default_factory=list)  # the term voters, after lexicons and patterns
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of terms, then of voters
    bias: float = -3.0
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))  # fires in class 0, class 1
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def terms_of(low: str, lengths: tuple[int, ...] = PREFIXES) -> set[str]:
    words = set(WORD.findall(low))
    found = set(words)
    for n in lengths:
        found.update({w[:n] + "*" for w in words if len(w) >= n})
    return found


class Voters:
    """Votes of one text as the bits of an integer: lexicons, phrases, addressed insults, tone, terms."""

    def __init__(self, induced: list[str]):
        self.lexicons: dict[str, int] = {}
        for i, v in enumerate(LEXICONS):
            for w in v.split():
                self.lexicons[w] = self.lexicons.get(w, 0) | 1 << i
        self.phrases = [(p, re.compile(rf"\b{re.escape(p)}\b"), len(LEXICONS) + i) for i, v in enumerate(PHRASES) for p in v]
        begin = len(LEXICONS) + len(PHRASES)
        self.addressed = [(re.compile(p), begin + i) for i, p in enumerate(ADDRESSED)]
        self.tone = [(re.compile(p), begin + len(ADDRESSED) + i) for i, p in enumerate(TONE)]
        self.induced = {t: i + FIXED for i, t in enumerate(induced)}
        self.lengths = tuple(sorted({len(t) - 1 for t in induced if t.endswith("*")}))
        self.count = FIXED + len(induced)

    def votes(self, text: str, low: str, terms: set[str]) -> int:
        mask = 0
        for w in self.lexicons.keys() & terms:
            mask |= self.lexicons[w]
        if mask:
            for p, bit in self.addressed:
                mask |= (p.search(low) is not None) << bit
        for plain, p, bit in self.phrases:
            if plain in low:
                mask |= (p.search(low) is not None) << bit
        for p, bit in self.tone:
            mask |= (p.search(text) is not None) << bit
        for t in self.induced.keys() & terms:
            mask |= 1 << self.induced[t]
        return mask


# ---- the label model


def bits(masks: np.ndarray, count: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(count) & 1).astype(np.float64)


def evidence(votes: np.ndarray, fires: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Log-odds of the votes, each weighted by its voter's share."""
    odds = np.log(fires[1] / fires[0]) * votes + np.log((1 - fires[1]) / (1 - fires[0])) * (1 - votes)
    return odds @ shares


def calibrate(votes: np.ndarray, y: np.ndarray, weight: np.ndarray, fires: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn the shared evidence into probabilities, by Newton steps on the labelled rows."""
    e, (a, b) = evidence(votes, fires, shares), (1.0, 0.0)
    x = np.stack([e, np.ones_like(e)], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * e + b, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-3 * weight.sum() * np.array([a - 1, 0])
        h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag([1e-3 * weight.sum(), 1e-9])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def posterior(votes: np.ndarray, scale: tuple[float, float], fires: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """P(toxic | votes)."""
    return 1 / (1 + np.exp(-np.clip(scale[0] * evidence(votes, fires, shares) + scale[1], -40, 40)))


def moments(votes: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each class: expected number of rows, of fires, and of joint fires."""
    found = []
    for q in (weight * (1 - p), weight * p):
        found += [[q.sum()], q @ votes, ((votes * q[:, None]).T @ votes).ravel()]
    return np.concatenate(found)


def maximize(sums: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Firing rates, shares and within-class correlations from the moments."""
    half = len(sums) // 2
    fires, cov, var = np.zeros((2, count)), np.zeros((count, count)), np.zeros(count)
    for c in (0, 1):
        part = sums[c * half : (c + 1) * half]
        n, first, second = part[0], part[1 : 1 + count], part[1 + count :].reshape(count, count)
        fires[c] = (first + (0.01 if c == 0 else 0.05)) / (n + 1)
        rate = first / max(n, 1e-9)
        cov += second - n * np.outer(rate, rate)
        var += n * rate * (1 - rate)
    fires = np.clip(fires, 1e-6, 1 - 1e-6)
    rho = cov / np.sqrt(np.outer(var, var) + 1e-12)
    np.fill_diagonal(rho, 0)
    shares = 1 / (1 + np.clip(rho, 0, 1).sum(1))
    return fires, shares, rho


def expectation(patterns: DataFrame, count: int, params: tuple) -> np.ndarray:
    """Moments over all documents, from (mask, n) rows."""
    scale, fires, shares = params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            masks, n = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(float)
            for i in range(0, len(masks), 4096):
                votes = bits(masks[i : i + 4096], count)
                got = moments(votes, n[i : i + 4096], posterior(votes, scale, fires, shares))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    sums = np.zeros(2 * (1 + count + count * count))
    for r in patterns.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r["i"]] = r["v"]
    return sums


# ---- training


def labelled_sample(docs: DataFrame, labels: DataFrame, fold: int, rows: int) -> DataFrame:
    """At most `rows` training rows (toxic, text), half of either class where there are enough.

    Rows are drawn by a hash of the id. Of repeated ids the highest label and the
    first text count, and of repeated texts one; null ids and labels other than 0 and 1 are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(remainder(F.col("doc_id"), fold) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for c in (0, 1)]
    chosen = F.broadcast(drawn[0].unionAll(drawn[1]))  # at most `rows` pairs of numbers
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id")
    once = found.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), F.min("text").alias("text"))
    return materialize(once.groupBy("text").agg(F.max("toxic").alias("toxic")))


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): in how many sample rows of either class a term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", max_bytes=4 << 20):
            seen = (Counter(), Counter())
            for y, t in zip(batch.column(batch.schema.get_field_index("toxic")).to_pylist(), texts(batch, "text")):
                seen[y].update(terms_of(t.decode("utf-8", "replace").lower()))
            for y, counts in enumerate(seen):
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(list(counts.values()) if y else [0] * n, pa.int64()), pa.array([0] * n if y else list(counts.values()), pa.int64())], names=["term", "toxic", "clean"])

    return sample.transform(small_batches).mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def distinctive(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """Terms of toxic rows, with the likelihood ratio `gain` against one rate for both classes."""

    def part(seen, rows):  # noqa: ANN001, ANN202
        expected = (F.col("toxic") + F.col("clean")) * rows / (n1 + n0)
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    gain = part(F.col("toxic"), n1) + part(F.col("clean"), n0)
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    return counts.withColumn("gain", gain).where((odds > 1) & (F.col("gain") > 6))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps with momentum estimates."""
    w = np.zeros(x.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -30, 30)))
        d = (p - y) * weight / weight.sum()
        g = np.append(x.T @ d.astype(np.float32), d.sum()) + decay * np.append(w[:-1], 0)
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        w -= 0.1 * first / (1 - 0.9**k) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, fold: int = 5, sample_rows: int = 8000, features: int = 1200, rounds: int = 6, anchor: float = 1.0, sample_docs: int = 8000) -> Model:
    """Fit voters, label model and classifier.

    sample_rows bounds the labelled rows that choose the term voters and set
    the classes' balance; the label model's votes and moments cover every
    document. The classifier is fitted on posterior labels alone: of those rows
    and of about `sample_docs` different texts outside of the held-out fold,
    drawn by a hash of the text, with no label needed. anchor: mass of the
    labelled rows in the label model, next to all documents. Without
    labelled rows of both classes the lexicon and pattern voters stand alone.
    """
    sample = labelled_sample(docs, labels, fold, sample_rows)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    counts = term_counts(sample)
    found = distinctive(counts, n1, n0).orderBy(F.desc("gain"), "term").limit(features).collect() if n1 and n0 else []
    best = [r["term"] for r in found]
    alone = {(r["term"][: PREFIXES[0]], r["toxic"], r["clean"]): r["term"] for r in reversed(found)}  # nested terms on the same rows vote once
    voters = Voters([t for t in best if t in set(alone.values())][: MAX_VOTERS - FIXED])
    known = [(r["toxic"], set(r["terms"]), r["mask"]) for r in _sample_rows(sample, best, voters).collect()]
    votes = bits(np.array([k[2] for k in known], np.int64), voters.count)
    y = np.array([k[0] for k in known], float)
    if not (n1 and n0):
        votes = np.concatenate([np.zeros((19 * voters.count, voters.count)), np.eye(voters.count)])  # each voter is right when it fires
        y = votes.sum(1)
    patterns = materialize(_votes(docs, voters).groupBy("mask").agg(F.count("*").alias("n")))
    total = float(patterns.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    share = n1 / max(1, n0 + n1) if n1 and n0 else 0.05
    true_share = _label_share(labels, fold, share)
    balance = np.where(y == 1, true_share / max(y.mean(), 1e-9), (1 - true_share) / max(1 - y.mean(), 1e-9))
    fixed = moments(votes, balance * anchor * max(total, len(y)) / len(y), y)
    fires, shares, rho = maximize(fixed, voters.count)
    scale = calibrate(votes, y, balance, fires, shares)
    for _ in range(rounds if total else 0):
        fires, shares, rho = maximize(fixed + expectation(patterns, voters.count, (scale, fires, shares)), voters.count)
        scale = calibrate(votes, y, balance, fires, shares)
    rows, weight = [(terms, v) for (_, terms, _), v in zip(known, votes)], balance
    if n1 and n0:
        drawn = _sample_rows(unlabelled_sample(docs, fold, sample_docs, total), best, voters).collect()
        more = bits(np.array([r["mask"] for r in drawn], np.int64), voters.count)
        rows += [(r["terms"], v) for r, v in zip(drawn, more)]
        weight = np.concatenate([balance, np.ones(len(drawn))])
    else:
        rows = [((), v) for v in votes]
    every = np.array([v for _, v in rows]).reshape(len(rows), voters.count)
    target = posterior(every, scale, fires, shares)
    place = {t: i for i, t in enumerate(best)}
    x = np.zeros((len(rows), len(best) + voters.count), np.float32)
    for i, (terms, _) in enumerate(rows):
        x[i, [place[t] for t in terms]] = 1
    x[:, len(best) :] = every
    weights, bias = _logistic(x, target, weight)
    return Model(best, list(voters.induced), weights, bias, fires, rho)


def unlabelled_sample(docs: DataFrame, fold: int, rows: int, total: float) -> DataFrame:
    """(toxic, text) of about `rows` different texts, of 2 * rows at most; toxic is 0 and means nothing."""
    share = int((1 << 30) * min(1.0, rows / max(1.0, total)))
    usable = docs.where(remainder(F.col("doc_id"), fold) != 0).select("text").where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share))
    return usable.groupBy("text").agg(F.lit(0).alias("toxic")).limit(2 * rows).select("toxic", "text")


def _label_share(labels: DataFrame, fold: int, default: float) -> float:
    """The share of toxic rows among the training rows' labels."""
    r = labels.where(F.col("toxic").isin(0, 1)).where(remainder(F.col("doc_id"), fold) != 0).agg(F.avg("toxic")).first()[0]
    return float(np.clip(default if r is None else r, 1e-3, 0.999))


def _sample_rows(sample: DataFrame, best: list[str], voters: Voters) -> DataFrame:
    wanted = set(best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", max_bytes=4 << 20):
            hits, masks = [], []
            for raw in texts(batch, "text"):
                text = raw.decode("utf-8", "replace")
                low = text.lower()
                found = terms_of(low)
                hits.append(sorted(wanted & found))
                masks.append(voters.votes(text, low, found))
            yield with_columns(batch, ["toxic"], {"terms": pa.array(hits, pa.list_(pa.string())), "mask": pa.array(masks, pa.int64())})

    return sample.select("toxic", "text").transform(small_batches).mapInArrow(run, "toxic int, terms array<string>, mask long")


def _votes(docs: DataFrame, voters: Voters) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", max_bytes=4 << 20):
            masks = []
            for raw in texts(batch, "text"):
                text = raw.decode("utf-8", "replace")
                low = text.lower()
                masks.append(voters.votes(text, low, terms_of(low, voters.lengths)))
            yield pa.RecordBatch.from_arrays([pa.array(masks, pa.int64())], names=["mask"])

    return docs.select("text").transform(small_batches).mapInArrow(run, "mask long")


# ---- scoring


class Scorer:
    def __init__(self, model: Model):
        self.voters = Voters(model.votes)
        self.weight = dict(zip(model.terms, model.weights.tolist()))
        self.vote_weight = model.weights[len(model.terms) :]
        self.bias = model.bias
        self.lengths = tuple(sorted({len(t) - 1 for t in model.terms if t.endswith("*")}))

    def score(self, raw: bytes) -> float:
        text = raw.decode("utf-8", "replace")
        low = text.lower()
        found = terms_of(low, self.lengths)
        mask = self.voters.votes(text, low, found)
        logit = self.bias + sum(self.weight[t] for t in self.weight.keys() & found)
        logit += sum(float(w) for i, w in enumerate(self.vote_weight) if mask >> i & 1)
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and score (0 to 1) of every row; a null text scores as an empty one."""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in pieces(batches, "text", max_bytes=4 << 20):
            yield with_columns(batch, names, {"score": pa.array([scorer.score(t) for t in texts(batch, "text")], pa.float64())})

    fields = [T.StructField(n, docs.schema[n].dataType) for n in names]
    return docs.select(*dict.fromkeys([*names, "text"])).transform(small_batches).mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def predict(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents."""
    rows = score(docs, learn(docs, labels, fold))
    return rows.select("doc_id", (remainder(F.col("doc_id"), fold) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of documents, all columns, that score below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in pieces(batches, "text", max_bytes=4 << 20):
            yield batch.filter(pa.array([scorer.score(t) < below for t in texts(batch, "text")], pa.bool_()))

    return docs.transform(small_batches).mapInArrow(run, docs.schema)
