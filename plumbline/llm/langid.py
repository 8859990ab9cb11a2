"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network reads windows of `window` bytes, forwards and backwards, from a
zero state; a softmax over both states labels every byte. All windows of a text
are read, and the document's probability of a language is the mean over all its
bytes, so no part of a text is left out and none weighs more. Training is
backpropagation through time in numpy on the driver, over one window from each
document of a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import binary_column, pieces, remainder, small_batches, texts, with_columns

UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    labels: list[str]
    hidden: int
    window: int
    weights: dict[str, np.ndarray]  # for each direction d: d_x (3h, 256), d_u (3h, h), d_b (3h); out (k, 2h), bias (k)


# ---- the network; arrays are (features, windows) so that gates are contiguous


def _step(w: dict, d: str, h: int, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
    """One gated step: update gate z, reset gate r, candidate n."""
    gx = np.take(w[f"{d}_x"], x, axis=1, mode="clip")
    gu = w[f"{d}_u"] @ state + w[f"{d}_b"][:, None]
    zr = np.tanh((gx[: 2 * h] + gu[: 2 * h]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
    z, r = zr[:h], zr[h:]
    n = np.tanh(gx[2 * h :] + r * gu[2 * h :])
    return n + z * (state - n), z, r, n, gu[2 * h :]


def _states(model: Model, x: np.ndarray, valid: np.ndarray) -> tuple[list, list]:
    """States of both directions at every position; padding leaves a state as it was."""
    h, w, (steps, count) = model.hidden, model.weights, x.shape
    found = []
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        state, out = np.zeros((h, count), np.float32), [None] * steps
        for t in order:
            new = _step(w, d, h, x[t], state)[0]
            state = new if valid[t].all() else np.where(valid[t], new, state)
            out[t] = state
        found.append(out)
    return found[0], found[1]


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(0))
    return e / e.sum(0)


def window_probabilities(model: Model, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Sum over a window's bytes of the label probabilities: (labels, windows)."""
    forward, backward = _states(model, x, valid)
    total = np.zeros((len(model.labels), x.shape[1]), np.float32)
    left, right = model.weights["out"][:, : model.hidden], model.weights["out"][:, model.hidden :]
    for t in range(x.shape[0]):
        p = _softmax(left @ forward[t] + right @ backward[t] + model.weights["bias"][:, None])
        total += p if valid[t].all() else p * valid[t]
    return total


def gradients(model: Model, x: np.ndarray, valid: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all bytes and its gradient, by backpropagation through time."""
    h, w, (steps, count) = model.hidden, model.weights, x.shape
    kept: dict[str, list] = {}
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        state, tape = np.zeros((h, count), np.float32), [None] * steps
        for t in order:
            new, z, r, n, un = _step(w, d, h, x[t], state)
            tape[t] = (state, z, r, n, un)
            state = np.where(valid[t], new, state)
            tape[t] += (state,)
        kept[d] = tape
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    total, scale = 0.0, np.float32(1 / max(1, valid.sum()))
    target = np.zeros((len(model.labels), count), np.float32)
    target[y, np.arange(count)] = 1
    back = {"f": [None] * steps, "b": [None] * steps}
    for t in range(steps):
        both = np.concatenate([kept["f"][t][5], kept["b"][t][5]])
        p = _softmax(w["out"] @ both + w["bias"][:, None])
        total -= float((np.log(p[y, np.arange(count)] + 1e-12) * valid[t]).sum()) * scale
        delta = (p - target) * valid[t] * scale
        grads["out"] += delta @ both.T
        grads["bias"] += delta.sum(1)
        into = w["out"].T @ delta
        back["f"][t], back["b"][t] = into[:h], into[h:]
    for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
        carried = np.zeros((h, count), np.float32)
        for t in order:
            state, z, r, n, un, _ = kept[d][t]
            whole = carried + back[d][t]
            g = np.where(valid[t], whole, 0)
            dn, dz = g * (1 - z) * (1 - n * n), g * (state - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            gate = np.concatenate([dz, dr, dn * r])
            grads[f"{d}_u"] += gate @ state.T
            grads[f"{d}_b"] += gate.sum(1)
            np.add.at(grads[f"{d}_x"].T, x[t], np.concatenate([dz, dr, dn]).T)
            carried = np.where(valid[t], g * z + w[f"{d}_u"].T @ gate, whole)
    return total, grads


def fit(samples: list[tuple[bytes, str]], hidden: int = 8, window: int = 128, epochs: int = 10, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Model:
    """Train on (text, label) pairs, one window each; without samples every text is `und`."""
    labels = sorted({y for _, y in samples})
    rng, k, h = np.random.default_rng(seed), max(1, len(labels)), hidden
    w = {"out": rng.normal(0, 0.3, (k, 2 * h)), "bias": np.zeros(k)}
    for d in "fb":
        w |= {f"{d}_x": rng.normal(0, 0.5, (3 * h, 256)), f"{d}_u": rng.normal(0, h**-0.5, (3 * h, h)), f"{d}_b": np.zeros(3 * h)}
    model = Model(labels, h, window, {n: v.astype(np.float32) for n, v in w.items()})
    if not samples:
        return model
    data = [np.frombuffer(s[:window], np.uint8) for s, _ in samples]
    x = np.zeros((window, len(data)), np.int64)
    valid = np.zeros((window, len(data)), bool)
    for i, s in enumerate(data):
        x[: len(s), i], valid[: len(s), i] = s, True
    y = np.searchsorted(labels, [v for _, v in samples])
    first = {n: np.zeros_like(v) for n, v in model.weights.items()}
    second = {n: np.zeros_like(v) for n, v in model.weights.items()}
    count, steps = 0, epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(order), batch):
            part, count = order[i : i + batch], count + 1
            _, grads = gradients(model, x[:, part], valid[:, part], y[part])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * (1 - 0.9 * count / steps)
            clip = min(1.0, 1.0 / (norm + 1e-9))
            for n, g in grads.items():
                g = g * clip
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.01 * (g * g - second[n])
                m, v = first[n] / (1 - 0.9**count), second[n] / (1 - 0.99**count)
                model.weights[n] -= (now * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return model


# ---- Spark


def training_sample(docs: DataFrame, label: str, text: str, rows: int, window: int) -> list[tuple[bytes, str]]:
    """At most `rows` labelled windows, as many from each label as there are, up to an equal share.

    Rows are chosen by a hash of their text, and the window's place in the text
    by the same hash, so the sample doesn't depend on how the table is stored.
    """
    usable = docs.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(label).cast("string").alias("y"), F.col(text).alias("t"))
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    if not counts:
        return []
    share = max(1, rows // len(counts))
    drawn = F.pmod(F.xxhash64("t"), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(v) for y, n in counts.items() for v in (y, int((1 << 30) * min(1.0, 1.2 * share / n)))])
    start = F.lit(1) + F.pmod(F.xxhash64("t", F.lit("place")), F.greatest(F.lit(1), F.length("t") - window)).cast("int")
    chosen = usable.where(drawn <= limit[F.col("y")]).select("y", drawn.alias("h"), F.substring(F.col("t"), start, F.lit(window)).alias("t"))
    found: dict[str, list] = {}
    for r in chosen.dropDuplicates().orderBy("h", "t", "y").limit(2 * rows).collect():
        found.setdefault(r["y"], []).append((r["t"].encode()[:window], r["y"]))
    return [s for y in sorted(found) for s in found[y][:share]]


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", fold: int = 5, sample_rows: int = 4000, **settings) -> Model:
    """Fit on rows whose crc32(doc_id) mod `fold` is not 0, from at most `sample_rows` of them."""
    window = settings.get("window", 128)
    return fit(training_sample(docs.where(remainder(F.col(doc_id), fold) != 0), label, text, sample_rows, window), **settings)


def document_probabilities(model: Model, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, windows: int = 4096) -> np.ndarray:
    """(documents, labels): the mean over each text's bytes; zeros for an empty text."""
    size = model.window
    per = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), per)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    first = starts[owner] + begin * size
    left = np.minimum(size, lengths[owner] - begin * size)
    order = np.argsort(-left, kind="stable")
    total = np.zeros((len(lengths), len(model.labels)))
    for i in range(0, len(order), windows):
        part = order[i : i + windows]
        longest = int(left[part[0]])
        places = first[part][None, :] + np.arange(longest)[:, None]
        x = np.take(raw, places, mode="clip").astype(np.intp)
        np.add.at(total, owner[part], window_probabilities(model, x, np.arange(longest)[:, None] < left[part][None, :]).T)
    return total / np.maximum(1, lengths)[:, None]


def label_batch(model: Model, batch: pa.RecordBatch, text: str) -> tuple[list[str], list[float]]:
    """Predicted language and its probability, for each row."""
    letters = np.array([LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts(batch, text)], bool)
    if not model.labels:
        return [UNDETERMINED] * len(letters), [0.0] * len(letters)
    p = document_probabilities(model, *binary_column(batch, text))
    best = p.argmax(1)
    score = np.clip(p[np.arange(len(best)), best], 0, 1)
    return [model.labels[b] if ok else UNDETERMINED for b, ok in zip(best, letters)], np.where(letters, score, 0.0).tolist()


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, lang_pred and score for every row.

    A null text, or one without a letter, is `und` with score 0. Ties go to the
    label that sorts first. Repeated rows come back as often as they came.
    """
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, max_bytes=2 << 20):
            lang, score = label_batch(model, batch, text)
            yield with_columns(batch, names, {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    fields = [T.StructField(n, docs.schema[n].dataType) for n in names]
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.select(*dict.fromkeys([*names, text])).transform(small_batches).mapInArrow(run, T.StructType(fields + more))


def predict(docs: DataFrame, fold: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents."""
    rows = identify(docs, learn(docs, fold=fold))
    return rows.select("doc_id", (remainder(F.col("doc_id"), fold) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.35, text: str = "text") -> DataFrame:
    """The rows of documents, all columns, whose language is identified with at least this score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, max_bytes=2 << 20):
            lang, score = label_batch(model, batch, text)
            yield batch.filter(pa.array([y != UNDETERMINED and s >= least for y, s in zip(lang, score)], pa.bool_()))

    return docs.transform(small_batches).mapInArrow(run, docs.schema)
