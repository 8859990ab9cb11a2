"""Cutting texts to a budget, each cut with a receipt: nested JSON, lists of rows, delimited text, prose.

A budget is given in tokens of four characters. What is cut is named by kind,
path, digest, bytes and number; nothing that is dropped goes without an entry.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.canon import BYTES_RECIPE, canonical, digest, digest_bytes
from plumbline.functions.textual import bound
from plumbline.operators.scoring import ROW_CAPS, is_table, sentences

#: Characters of a string, items of a list and keys of an object, at first and at least; rounds of halving; markers.
FIRST_CAPS, LEAST_CAPS, ROUNDS = (300, 20, 200), (20, 2, 4), 12
KEYS_MARK, ROWS_MARK, GAP = "__distilled_dropped_keys__", "__distilled_dropped_rows__", "[...]"
SCHEMA = "distill:receipt:v1"
DROPS = "array<struct<kind:string,path:string,digest:string,dropped_bytes:long,dropped_count:long>>"
_DROP_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("path", pa.string()), ("digest", pa.string()), ("dropped_bytes", pa.int64()), ("dropped_count", pa.int64())]))


def _compact(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _ends(items: list, cap: int) -> tuple[list, list, list]:
    """Head (half of the cap, rounded up), middle and tail."""
    head = -(-cap // 2)
    last = max(head, len(items) - (cap - head))
    return items[:head], items[head:last], items[last:]


def _drop(kind: str, path: str, gone: object, count: int) -> dict:
    return {"kind": kind, "path": path or "$", "digest": digest(gone), "dropped_bytes": len(_compact(gone).encode()), "dropped_count": count}


def _capped(value: object, caps: tuple[int, int, int], path: str, drops: list[dict]) -> object:
    """The value with its strings, lists and objects cut to the caps; what goes is added to drops, inner cuts first."""
    text_cap, list_cap, key_cap = caps
    if isinstance(value, str) and len(value) > text_cap:
        gone = value[text_cap:]
        drops.append({"kind": "string_truncated", "path": path or "$", "digest": BYTES_RECIPE + hashlib.sha256(gone.encode()).hexdigest(), "dropped_bytes": len(gone.encode()), "dropped_count": len(gone)})
        return f"{value[:text_cap]}...+{len(gone)} more chars"
    if isinstance(value, dict):
        below = lambda items: {k: _capped(v, caps, f"{path}.{k}" if path else k, drops) for k, v in items}
        if len(value) <= key_cap:
            return below(value.items())
        head, gone, tail = _ends(list(value.items()), key_cap)
        kept = {**below(head), KEYS_MARK: len(gone), **below(tail)}
        drops.append(_drop("dict_truncated", path, dict(gone), len(gone)))
        return kept
    if isinstance(value, list):
        below = lambda items: [_capped(v, caps, f"{path}[{i}]", drops) for i, v in items]
        if len(value) <= list_cap:
            return below(enumerate(value))
        head, gone, tail = _ends(list(enumerate(value)), list_cap)
        kept = [*below(head), f"...+{len(gone)} more items", *below(tail)]
        drops.append(_drop("list_truncated", path, [v for _, v in gone], len(gone)))
        return kept
    return value


def _tree(value: object, budget: int) -> tuple[object, list[dict]]:
    """The first of the shrinking rounds that fits the budget, else the smallest."""
    caps, tried = FIRST_CAPS, []
    for _ in range(ROUNDS):
        drops: list[dict] = []
        kept = _capped(value, caps, "", drops)
        tried.append((len(_compact(kept)), kept, drops))
        if tried[-1][0] <= budget or caps == LEAST_CAPS:
            break
        caps = tuple(max(least, cap // 2) for cap, least in zip(caps, LEAST_CAPS))
    return min(tried, key=lambda t: t[0])[1:]


def _rows(rows: list, budget: int) -> tuple[object, list[dict]]:
    """The widest of the row caps that fits the budget, else the narrowest."""
    for cap in ROW_CAPS:
        head, gone, tail = _ends(rows, cap) if len(rows) > cap else (rows, [], [])
        mark = {ROWS_MARK: len(gone)} if isinstance(rows[0], dict) else [f"...+{len(gone)} rows dropped..."]
        kept = [*head, mark, *tail] if gone else rows
        if len(_compact(kept)) <= budget:
            break
    return kept, [_drop("rows_dropped", "$", gone, len(gone))] if gone else []


def _is_rows(value: object) -> bool:
    """Two or more objects, or lists of at most two different lengths."""
    if not isinstance(value, list) or len(value) < 2:
        return False
    return all(isinstance(r, dict) for r in value) or (all(isinstance(r, list) for r in value) and len({len(r) for r in value}) <= 2)


def _structured(raw: str | None, budget: int) -> dict | None:
    """What becomes of JSON text; None if it isn't any."""
    if raw is None or raw.strip()[:1] not in ("{", "["):
        return None
    try:
        value = json.loads(raw.strip())
    except RecursionError:
        return {"strategy": "refused"}
    except ValueError:
        return None
    try:
        canonical(value).encode()  # neither NaN nor lone surrogates have a stable form
        strategy, cut = ("rows", _rows) if _is_rows(value) else ("json", _tree)
        kept, drops = cut(value, budget)
        return {"strategy": strategy, "content": _compact(kept), "digest": digest(kept), "bytes": len(canonical(kept).encode()), "drops": drops}
    except (ValueError, RecursionError):
        return {"strategy": "refused"}


def _cut_json(rows: DataFrame, budget: int) -> DataFrame:
    """rows (id, text) with `j`: strategy, content, digest, bytes and drops of those that are JSON."""
    kind = pa.struct([("strategy", pa.string()), ("content", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("drops", _DROP_TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([_structured(t, budget) for t in batch.column(1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=["id", "text", "j"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, text string, j struct<strategy:string,content:string,digest:string,bytes:long,drops:{DROPS}>"
    return rows.select("id", "text").mapInArrow(run, schema)


def _one_drop(kind: str, path: str, gone: Column, count: Column) -> Column:
    """One entry, or none where nothing is gone."""
    entry = F.struct(F.lit(kind).alias("kind"), F.lit(path).alias("path"), digest_bytes(gone.cast("binary")).alias("digest"), F.octet_length(gone).cast("long").alias("dropped_bytes"), count.cast("long").alias("dropped_count"))
    return F.when(count > 0, F.array(entry)).otherwise(F.array().cast(DROPS))


def table_cut(text: Column, budget: int) -> Column:
    """struct(content, drops) of delimited text: the head line, a rule of dashes behind it, and the head and tail of the rows.

    Line feeds before and behind the table stay. The widest row cap that fits
    the budget is taken, else the narrowest; a table within the first cap is
    never cut.
    """
    edges = lambda i: F.regexp_extract(text, r"^(\n*)((?s:.*?))(\n*)$", i)

    def cut(lines: Column) -> Column:
        ruled = (F.size(lines) > 1) & F.coalesce(F.get(lines, F.lit(1)).rlike(r"^(?U:[\s|:-]+)$"), F.lit(False))
        top = F.when(ruled, 2).otherwise(1)
        n = F.size(lines) - top

        def with_cap(cap: int) -> Column:
            head, tail = -(-cap // 2), cap // 2
            count = F.when(n > cap, n - cap).otherwise(0)
            kept = F.concat(F.slice(lines, 1, top + head), F.array(F.concat(F.lit("...+"), count.cast("string"), F.lit(" rows dropped..."))), F.slice(lines, F.size(lines) - tail + 1, F.lit(tail)))
            gone = F.slice(lines, top + head + 1, F.greatest(count, F.lit(0)))
            content = F.when(count > 0, F.concat(edges(1), F.array_join(kept, "\n"), edges(3))).otherwise(text)
            drops = bound(F.array_join(gone, "\n"), lambda g: _one_drop("rows_dropped", "$", g, count))
            last = F.lit(cap == ROW_CAPS[-1])
            return bound(content, lambda c: F.when(last | (F.length(c) <= budget) | (count == 0), F.struct(c.alias("content"), drops.alias("drops"))))

        return F.coalesce(*map(with_cap, ROW_CAPS))

    return bound(F.split(edges(2), "\n"), cut)


def prose_cut(text: Column, budget: int, query: str | None = None) -> Column:
    """struct(content, drops) of prose: the sentences that matter most and fit, in their order, a mark in each gap.

    A sentence weighs the larger of 1 / (its place from the start) and 1 / (from
    the end), and 2 for each different word that it shares with the query; the
    earlier of equal ones goes first. Those that don't fit are passed over; the
    first always stays, and nothing is taken once the budget is used up.
    """
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]+)"), 1))
    asked = words(F.lit(query)) if query else None

    def chosen(parts: Column) -> Column:
        n = F.size(parts)

        def ranked(s: Column, i: Column) -> Column:
            place = F.greatest(F.lit(1.0) / (i + 1), F.lit(1.0) / (n - i))
            weight = place if asked is None else place + 2.0 * F.size(F.array_intersect(words(s), asked))
            return F.struct((-weight).alias("w"), i.alias("i"), F.length(s).alias("size"))

        def take(state: Column, s: Column) -> Column:
            cost = s["size"] + 1
            fits = (F.size(state["kept"]) == 0) | ((state["used"] < budget) & (state["used"] + cost <= budget))
            return F.struct(
                F.when(fits, state["used"] + cost).otherwise(state["used"]).alias("used"),
                F.when(fits, F.concat(state["kept"], F.array(s["i"]))).otherwise(state["kept"]).alias("kept"),
            )

        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
        return F.array_sort(F.aggregate(F.array_sort(F.transform(parts, ranked)), start, take)["kept"])

    def put(parts: Column, kept: Column) -> Column:
        marked = F.transform(kept, lambda i, k: F.when((k > 0) & (F.get(kept, k - 1) < i - 1), F.concat(F.lit(GAP + " "), F.get(parts, i))).otherwise(F.get(parts, i)))
        lost = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), kept), lambda i: F.get(parts, i))
        drops = bound(F.array_join(lost, " "), lambda g: _one_drop("sentences_dropped", "text", g, F.size(parts) - F.size(kept)))
        return F.struct(F.array_join(marked, " ").alias("content"), drops.alias("drops"))

    whole = F.struct(text.alias("content"), F.array().cast(DROPS).alias("drops"))
    cut = lambda parts: F.when(F.size(parts) == 0, whole).otherwise(bound(chosen(parts), lambda kept: put(parts, kept)))
    return F.when(F.length(text) <= budget, whole).otherwise(bound(sentences(text), cut))


def distill(rows: DataFrame, tokens: int, query: str | None = None) -> DataFrame:
    """(id, strategy, content, receipt) of rows (id, text), cut to a budget of so many tokens.

    strategy: json, rows (a JSON list of rows), table, text, refused (JSON
    without a stable form: NaN, lone surrogates, nesting too deep; no content
    and no receipt), or null for a null text. Repeated rows come back as often
    as they come; other columns play no part. The same text always gives the
    same content. The receipt is consistent by `receipt_state`.
    """
    budget = max(1, 4 * tokens)
    found = _cut_json(rows, budget)
    table, prose = table_cut(F.col("text"), budget), prose_cut(F.col("text"), budget, query)
    strategy = F.when(F.col("text").isNull(), F.lit(None)).when(F.col("j").isNotNull(), F.col("j.strategy")).when(is_table(F.col("text")), "table").otherwise("text")
    plain = F.when(F.col("strategy") == "table", table).when(F.col("strategy") == "text", prose)
    cut = found.withColumn("strategy", strategy).withColumn("p", plain)
    content = F.coalesce("p.content", "j.content")
    drops = F.coalesce("p.drops", "j.drops")
    raw = lambda c: F.struct(digest_bytes(c.cast("binary")).alias("digest"), F.octet_length(c).cast("long").alias("bytes"))
    kept = F.when(F.col("p").isNotNull(), raw(content)).otherwise(F.struct(F.col("j.digest").alias("digest"), F.col("j.bytes").alias("bytes")))
    receipt = F.struct(F.lit(SCHEMA).alias("schema"), F.col("strategy"), F.lit(tokens).alias("budget_tokens"), raw(F.col("text")).alias("full"), kept.alias("distilled"), drops.alias("drops"), (F.size(drops) > 0).alias("truncated"))
    return cut.select("id", "strategy", content.alias("content"), F.when(content.isNotNull(), receipt).alias("receipt"))


RECEIPT = f"schema string, full struct<digest:string,bytes:long>, distilled struct<digest:string,bytes:long>, drops {DROPS}, truncated boolean"


def receipt_state(raw: Column) -> Column:
    """What the JSON text of a receipt is, by itself: consistent, inconsistent, malformed, or unknown_schema.

    Digests must have their form and counts be whole numbers from 0 on, and
    `truncated` must say whether there are drops. No digest is held against
    content, which a receipt doesn't carry.
    """

    def state(raw: Column, parsed: Column) -> Column:
        formed = lambda d: F.coalesce(d.rlike(r"\Asha256:[^:]+:[^:]+:[0-9a-f]{64}\z"), F.lit(False))
        counted = lambda n: F.coalesce(n >= 0, F.lit(False))
        fine = formed(parsed["full"]["digest"]) & formed(parsed["distilled"]["digest"]) & counted(parsed["full"]["bytes"]) & counted(parsed["distilled"]["bytes"])
        fine = fine & F.forall(parsed["drops"], lambda d: formed(d["digest"]) & counted(d["dropped_bytes"]) & counted(d["dropped_count"]))
        fine = fine & (parsed["truncated"] == (F.size(parsed["drops"]) > 0))
        part = lambda name: F.get_json_object(raw, f"$.{name}")
        shape = part("full").startswith("{") & part("distilled").startswith("{") & part("drops").startswith("[") & part("truncated").isin("true", "false")
        shape = shape & ~F.coalesce(F.exists(parsed["drops"], lambda d: d.isNull()), F.lit(True))
        return (
            F.when(raw.isNull() | F.try_parse_json(raw).isNull() | ~F.coalesce(F.trim(raw).startswith("{"), F.lit(False)), "malformed")
            .when(F.coalesce(part("schema") != SCHEMA, F.lit(True)), "unknown_schema")
            .when(~F.coalesce(shape, F.lit(False)), "malformed")
            .when(F.coalesce(fine, F.lit(False)), "consistent")
            .otherwise("inconsistent")
        )

    return bound(raw, lambda r: bound(F.from_json(r, RECEIPT), lambda parsed: state(r, parsed)))
