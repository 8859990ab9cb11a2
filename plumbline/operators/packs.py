"""Evidence packs: a window of a ledger with what can be derived from it, sealed; and their check, which derives everything anew.

A pack is rows of four tables: window (pack, line, raw), fields (pack, section,
field, value), pins (pack, rows, chain) and manifest (pack, digest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.canon import GENESIS
from plumbline.functions.verdicts import worst_of
from plumbline.operators import chain
from plumbline.operators.rows import read_rows
from plumbline.session import settled

#: Outcomes from the worst on; the third says that a check could not be made, and is no pass.
BAD, CNL, GOOD = "bad", "could_not_look", "good"
OUTCOMES = [BAD, CNL, GOOD]
#: Checks, and those that each rests on: it can't be made unless they are good.
CHECKS = {"manifest": [], "window": [], "complete": ["window"], "chain": ["window"], "export": ["window"], "mandate": ["window"], "statements": ["window"], "pins": []}
FIELDS = ["pack", "section", "field", "value"]


def _read(window: DataFrame) -> DataFrame:
    return read_rows(window.withColumnRenamed("pack", "ledger_id")).withColumnRenamed("ledger_id", "pack")


def _long(sums: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    each = [F.struct(F.lit(s).alias("section"), F.lit(n).alias("field"), F.coalesce(F.col(n).cast("string"), F.lit("")).alias("value")) for s, names in sections.items() for n in names]
    return sums.select("pack", F.explode(F.array(*each)).alias("f")).select("pack", "f.*")


def derived(packs: DataFrame, window: DataFrame, allowed: list[str], read: DataFrame | None = None) -> DataFrame:
    """(FIELDS) of every pack (pack): all that its window says; `read` are the window's rows where they have been read before.

    export: rows, first and last line, head, newest time, and rows by event.
    mandate: rows whose event is allowed, denied, or can't be told. statements:
    what could not be looked at, which a pack has to say itself.
    """
    rows = _read(window) if read is None else read
    part = lambda k: F.get_json_object("body", f"$.{k}")
    rows = rows.withColumns({"event": part("event"), "ts": part("ts"), "read": F.col("state") == "row"})
    known = F.col("event").isNotNull()
    sums = rows.groupBy("pack").agg(
        F.count("*").alias("rows"),
        F.min("line").alias("first_line"),
        F.max("line").alias("last_line"),
        F.max_by("chain", F.when(F.col("read"), F.col("line"))).alias("head"),
        F.max("ts").alias("newest"),
        F.count_if(known & F.col("event").isin(allowed)).alias("allowed"),
        F.count_if(known & ~F.col("event").isin(allowed)).alias("denied"),
        F.count_if(~known).alias("undecided"),
        F.count_if(~F.col("read")).alias("unreadable"),
        F.count_if(F.col("read") & F.col("ts").isNull()).alias("undated"),
    )
    sums = packs.join(sums, "pack", "left").fillna(0, ["rows", "allowed", "denied", "undecided", "unreadable", "undated"]).withColumn("empty", (F.col("rows") == 0).cast("int"))
    events = rows.where(known).groupBy("pack", "event").agg(F.count("*").alias("n"))
    by_event = events.select("pack", F.lit("export").alias("section"), F.concat(F.lit("event:"), "event").alias("field"), F.col("n").cast("string").alias("value"))
    fields = _long(sums, {"export": ["rows", "first_line", "last_line", "head", "newest"], "mandate": ["allowed", "denied", "undecided"], "statements": ["unreadable", "undated", "empty"]})
    return fields.where("section <> 'statements' or value <> '0'").unionAll(by_event)


def _mixed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """(pack, name): a digest of a pack's rows in any order: their number, and sum and exclusive or of their hashes."""
    one = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 15), 16, 10).cast("long")
    sums = rows.groupBy("pack").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(one.cast("decimal(38,0)")).cast("string"), F.bit_xor(one).cast("string")).alias(name))
    return sums


def sealed(packs: DataFrame, window: DataFrame, fields: DataFrame, pins: DataFrame) -> DataFrame:
    """(pack, digest) over a pack's window, fields and pins; no table is gathered for it."""
    met = packs.join(_mixed(window, "w", "line", "raw"), "pack", "left").join(_mixed(fields, "f", "section", "field", "value"), "pack", "left").join(_mixed(pins, "p", "rows", "chain"), "pack", "left")
    return met.select("pack", F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("none")) for c in "wfp"]), 256).alias("digest"))


def in_window(source: DataFrame, since: str, until: str) -> DataFrame:
    """(pack, line, raw) of source lines (ledger_id, line, raw) whose `ts` lies from since to until; lines that can't be placed belong to every window."""
    rows = read_rows(source)
    at = F.get_json_object("body", "$.ts")
    placed = F.coalesce(at.between(since, until), F.lit(True))
    return rows.where((F.col("state") != "blank") & placed).select(F.col("ledger_id").alias("pack"), "line", "raw")


def build(source: DataFrame, pins: DataFrame, since: str, until: str, allowed: list[str]) -> dict[str, DataFrame]:
    """The tables of one pack a ledger, of source lines and of pins (ledger_id, rows, chain).

    Window and fields are computed once and kept: the seal reads them again.
    """
    packs = source.select(F.col("ledger_id").alias("pack")).distinct()
    window = settled(in_window(source, since, until))
    own = pins.select(F.col("ledger_id").alias("pack"), "rows", "chain")
    fields = settled(derived(packs, window, allowed))
    return {"window": window, "fields": fields, "pins": own, "manifest": sealed(packs, window, fields, own)}


def _outcome(bad: Column, unknown: Column | None = None) -> Column:
    found = F.when(bad, BAD)
    return (found if unknown is None else found.when(unknown, CNL)).otherwise(GOOD)


def check(packs: DataFrame, pack: dict[str, DataFrame], source: DataFrame, store: DataFrame, since: str, until: str, allowed: list[str]) -> DataFrame:
    """(pack, check, outcome) of every pack (pack) and check (CHECKS).

    manifest: the digest reproduces (without one it can't be told). window:
    every row is its source's line, once (without the source it can't be told).
    complete: no source line of the window is missing. chain: each row links to
    the one before it where that is in the pack and can be read, and the stated
    head is the last row's. export, mandate: every field derived anew is what the pack says, and
    it says no other. statements: nothing that could not be looked at goes
    unsaid; what is said is a could-not-look of the pack too. pins: every pin is
    in the store (ledger_id, rows, chain). A check that rests on another can't
    be made unless that is good.
    """
    window = pack["window"]
    again = sealed(packs, window, pack["fields"], pack["pins"]).withColumnRenamed("digest", "again")
    manifest = packs.join(again, "pack").join(pack["manifest"].groupBy("pack").agg(F.max("digest").alias("digest"), F.count_distinct("digest").alias("k")), "pack", "left")
    found = [manifest.select("pack", F.lit("manifest").alias("check"), _outcome((F.col("digest") != F.col("again")) | (F.col("k") > 1), F.col("digest").isNull()).alias("outcome"))]

    has = source.select(F.col("ledger_id").alias("pack")).distinct().withColumn("has", F.lit(True))
    lines = source.select(F.col("ledger_id").alias("pack"), "line", F.col("raw").alias("theirs"))
    once = window.groupBy("pack", "line").agg(F.count("*").alias("k"), F.max("raw").alias("raw"))
    differs = once.join(lines, ["pack", "line"], "left").groupBy("pack").agg(F.count_if((F.col("k") > 1) | ~F.col("raw").eqNullSafe(F.col("theirs"))).alias("bad"))
    missing = in_window(source, since, until).join(window.select("pack", "line"), ["pack", "line"], "left_anti").groupBy("pack").agg(F.count("*").alias("bad"))
    for name, sums in (("window", differs), ("complete", missing)):
        met = packs.join(has, "pack", "left").join(sums, "pack", "left")
        found.append(met.select("pack", F.lit(name).alias("check"), F.when(F.col("has").isNull(), CNL).when(F.coalesce("bad", F.lit(0)) > 0, BAD).otherwise(GOOD).alias("outcome")))

    rows = settled(_read(window).drop("raw"))
    before = rows.where("chain is not null").select("pack", (F.col("line") + 1).alias("line"), F.col("chain").alias("previous"))
    linked = rows.where("state = 'row'").join(before, ["pack", "line"], "left")
    want = chain.linked(F.coalesce("previous", F.lit(GENESIS)), F.col("body"))
    seen = F.col("previous").isNotNull() | (F.col("line") == 1)
    broken = linked.groupBy("pack").agg(F.count_if(seen & ~F.coalesce(F.col("chain") == want, F.lit(False))).alias("bad"), F.max_by("chain", "line").alias("last"))
    head = pack["fields"].where("section = 'export' and field = 'head'").groupBy("pack").agg(F.max("value").alias("head"))
    met = packs.join(broken, "pack", "left").join(head, "pack", "left")
    found.append(met.select("pack", F.lit("chain").alias("check"), _outcome((F.coalesce("bad", F.lit(0)) > 0) | (F.col("head") != F.coalesce("last", F.lit(""))), F.col("head").isNull()).alias("outcome")))

    fresh = derived(packs, window, allowed, rows).withColumnRenamed("value", "fresh")
    said = pack["fields"].groupBy("pack", "section", "field").agg(F.max("value").alias("value"), F.count("*").alias("k"))
    both = said.join(fresh, ["pack", "section", "field"], "full")
    odd = both.groupBy("pack", "section").agg(F.count_if(~F.col("value").eqNullSafe(F.col("fresh")) | (F.col("k") > 1)).alias("bad"), F.count("*").alias("n"))
    for name in ("export", "mandate", "statements"):
        met = packs.join(odd.where(F.col("section") == name), "pack", "left")
        unknown = F.coalesce("n", F.lit(0)) > 0 if name == "statements" else F.col("n").isNull()
        found.append(met.select("pack", F.lit(name).alias("check"), _outcome(F.coalesce("bad", F.lit(0)) > 0, unknown).alias("outcome")))

    known = store.select(F.col("ledger_id").alias("pack"), "rows", "chain").distinct().withColumn("there", F.lit(True))
    absent = pack["pins"].join(known, ["pack", "rows", "chain"], "left").groupBy("pack").agg(F.count_if(F.col("there").isNull()).alias("bad"), F.count("*").alias("n"))
    met = packs.join(absent, "pack", "left")
    found.append(met.select("pack", F.lit("pins").alias("check"), _outcome(F.coalesce("bad", F.lit(0)) > 0, F.col("n").isNull()).alias("outcome")))

    every = found[0]
    for one in found[1:]:
        every = every.unionAll(one)
    base = every.where("check = 'window'").select("pack", F.col("outcome").alias("base"))
    rests = F.col("check").isin([c for c, on in CHECKS.items() if on])
    return every.join(base, "pack").select("pack", "check", F.when(rests & (F.col("base") != GOOD), CNL).otherwise(F.col("outcome")).alias("outcome"))


def verdicts(checks: DataFrame) -> DataFrame:
    """(pack, verdict, bad, could_not_look): the worst of a pack's outcomes, and how many there are of each kind that is no pass."""
    return checks.groupBy("pack").agg(worst_of(F.col("outcome"), OUTCOMES).alias("verdict"), F.count_if(F.col("outcome") == BAD).alias("bad"), F.count_if(F.col("outcome") == CNL).alias("could_not_look"))
