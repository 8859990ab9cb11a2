"""Two independently kept records of the same calls: alignment, gaps, headline.

A tape is rows (session, idx, req, resp); idx counts a session's calls from 1.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def occurrence(tape: DataFrame) -> DataFrame:
    """Adds `nth`: which of the session's calls with this request it is."""
    return tape.withColumn("nth", F.row_number().over(Window.partitionBy("session", "req").orderBy("idx")))


def outer(agent: DataFrame, tool: DataFrame) -> DataFrame:
    """Each call of either tape with its counterpart, order aside: matched, altered, or missing on a side."""
    a = occurrence(agent).select("session", "req", "nth", F.col("idx").alias("a_idx"), F.col("resp").alias("a_resp"))
    t = occurrence(tool).select("session", "req", "nth", F.col("idx").alias("t_idx"), F.col("resp").alias("t_resp"))
    both = a.join(t, ["session", "req", "nth"], "full")
    verdict = (
        F.when(F.col("t_idx").isNull(), "missing_on_tool")
        .when(F.col("a_idx").isNull(), "missing_on_agent")
        .when(F.col("a_resp").eqNullSafe(F.col("t_resp")), "matched")
        .when(F.col("a_resp").isNull() | F.col("t_resp").isNull(), "missing_response")
        .otherwise("altered")
    )
    return both.withColumn("verdict", verdict)


def index_findings(tape: DataFrame) -> DataFrame:
    """Gaps, repeats and steps back of an index that should go 1, 2, 3, in file order `pos`."""
    before = Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    high = F.coalesce(F.max("idx").over(before), F.lit(0))
    rows = tape.withColumn("high", high)
    same = F.count("*").over(Window.partitionBy("session", "idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)) > 0
    kind = F.when(F.col("idx") > F.col("high") + 1, "gap").when(same, "repeat").when(F.col("idx") <= F.col("high"), "out_of_order")
    return rows.withColumn("finding", kind).where("finding is not null").select("session", "pos", "idx", "finding")


def headline(findings: DataFrame) -> DataFrame:
    """A session's headline: the earliest finding, of those at one call ALTERED before MISSING; both sides are `both`."""
    rank = F.when(F.col("verdict") == "ALTERED", 0).otherwise(1)
    first = findings.groupBy("session").agg(F.min(F.struct(F.coalesce("at", F.lit(0)).alias("at"), rank.alias("rank"))).alias("h"))
    same = findings.join(first, "session").where((F.coalesce("at", F.lit(0)) == F.col("h.at")) & (rank == F.col("h.rank")))
    sides = F.array_sort(F.collect_set("side"))
    named = same.groupBy("session").agg(F.min("h.at").alias("at"), F.min("verdict").alias("verdict"), sides.alias("sides"))
    return named.select("session", "at", "verdict", F.when(F.size("sides") > 1, "both").otherwise(F.get("sides", F.lit(0))).alias("side"))


def align(agent: DataFrame, tool: DataFrame) -> DataFrame:
    """(session, verdict, at, side): what keeps the two sides from being the same calls in the same order.

    Calls alike in request and response are counterparts, the first with the
    first. Of these the fewest whose removal leaves one order on both sides were
    moved: ALTERED at the agent's call. Of the calls left, those with one request
    differ in their response: ALTERED, or MISSING on the side that has none. The
    rest are MISSING on the other side.
    """
    nth = lambda t, *k: t.withColumn("nth", F.row_number().over(Window.partitionBy("session", *k).orderBy("idx")))
    side = lambda t, x: t.select("session", "req", "nth", *[F.col(c).alias(f"{x}_{c}") for c in ("idx", "resp")])
    a, t = (nth(x.select("session", "idx", "req", "resp"), "req", "resp") for x in (agent, tool))
    alike = ["session", "req", "nth"]
    both = side(a, "a").join(side(t, "t").withColumnsRenamed({c: f"_{c}" for c in alike}), (F.col("session") == F.col("_session")) & (F.col("req") == F.col("_req")) & (F.col("nth") == F.col("_nth")) & F.col("a_resp").eqNullSafe(F.col("t_resp")))
    both = both.select("session", "a_idx", "t_idx")
    left = nth(a.join(both.select("session", F.col("a_idx").alias("idx")), ["session", "idx"], "left_anti"), "req")
    over = nth(t.join(both.select("session", F.col("t_idx").alias("idx")), ["session", "idx"], "left_anti"), "req")
    rest = side(left, "a").join(side(over, "t"), alike, "full")
    lacks = F.when(F.col("t_idx").isNull(), "tool").when(F.col("a_idx").isNull(), "agent").when(F.col("t_resp").isNull(), "tool").when(F.col("a_resp").isNull(), "agent")
    found = rest.select("session", F.when(lacks.isNull(), "ALTERED").otherwise("MISSING").alias("verdict"), F.coalesce("a_idx", "t_idx").cast("long").alias("at"), lacks.alias("side"))
    return found.unionAll(moved(both).select("session", F.lit("ALTERED").alias("verdict"), F.col("a_idx").cast("long").alias("at"), F.lit(None).cast("string").alias("side")))


def moved(pairs: DataFrame) -> DataFrame:
    """The fewest pairs (session, a_idx, t_idx) without which both sides have one order.

    A session is cut where all pairs so far stand first on both sides; only
    stretches of more than one pair, which hold the moves, are looked at whole.
    """
    by = lambda c: F.row_number().over(Window.partitionBy("session").orderBy(c))
    ranked = pairs.select("*", by("a_idx").alias("a"), by("t_idx").alias("t"))
    so_far = Window.partitionBy("session").orderBy("a")
    ends = ranked.withColumn("ends", (F.max("t").over(so_far) == F.col("a")).cast("long"))
    cut = ends.withColumn("stretch", F.sum("ends").over(so_far) - F.col("ends"))
    several = cut.groupBy("session", "stretch").agg(F.count("*").alias("n")).where("n > 1").select("session", "stretch")

    def out_of_order(stretch: pd.DataFrame) -> pd.DataFrame:
        rows = stretch.sort_values("a", ignore_index=True)
        kept = longest_rising(rows["t"].tolist())
        return rows.drop(index=kept)[["session", "a_idx", "t_idx"]]

    return cut.join(several, ["session", "stretch"]).groupBy("session", "stretch").applyInPandas(out_of_order, pairs.select("session", "a_idx", "t_idx").schema)


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence of different numbers."""
    ends: list[int] = []  # place of the smallest end of each length
    before: list[int] = []
    for place, value in enumerate(values):
        k = bisect_left(ends, value, key=values.__getitem__)
        before.append(ends[k - 1] if k else -1)
        ends[k : k + 1] = [place]
    found, place = [], ends[-1] if ends else -1
    while place >= 0:
        found.append(place)
        place = before[place]
    return found[::-1]


def check_pins(pins: DataFrame, tape: DataFrame) -> DataFrame:
    """Each pin (session, rows, chain) against a tape (session, idx, chain): short, differs or agrees."""
    sizes = tape.groupBy("session").agg(F.max("idx").alias("n"))
    met = pins.join(sizes, "session", "left").join(tape.select("session", F.col("idx").alias("rows"), F.col("chain").alias("local")), ["session", "rows"], "left")
    word = F.when(F.coalesce("n", F.lit(0)) < F.col("rows"), "short").when(F.coalesce(F.col("local") == F.lower("chain"), F.lit(False)), "agrees").otherwise("differs")
    return met.select("session", "rows", word.alias("finding"))


def supersedes(rows: DataFrame) -> dict[str, DataFrame]:
    """Forks, resolvers and conflicts of rows (pos, id, supersedes array).

    forks: (old, claimant, last) for ids that two rows or more supersede, last
    being the last such row; resolved: the forks that just one later row
    resolves, by superseding all their claimants (two or more of them);
    conflicts: a fork's first resolver, and the first of each other set of
    claimants that a resolver names. Sets are compared by digests, and none is
    gathered.
    """
    edges = rows.select("pos", "id", F.explode("supersedes").alias("old")).distinct()
    forks = edges.groupBy("old").agg(F.max("pos").alias("last"), F.countDistinct("id").alias("n")).where("n >= 2")
    # a resolver names at least two claimants, so it meets the fork on one of them
    members = forks.join(edges.select("old", F.col("id").alias("claimant")).distinct(), "old")
    named = members.join(edges.select(F.col("pos").alias("rpos"), F.col("id").alias("rid"), F.col("old").alias("claimant")), "claimant").where("rpos > last")
    one = F.xxhash64("claimant")
    covers = named.groupBy("old", "rpos", "rid", "n").agg(F.count("*").alias("hit"), F.struct(F.bit_xor(one), F.sum(one.cast("decimal(20,0)"))).alias("set")).where("hit >= 2")
    whole = covers.where("hit = n").groupBy("old").agg(F.count("*").alias("k"), F.min("rid").alias("resolver")).where("k = 1")
    sets = covers.groupBy("old", "set").agg(F.min(F.struct("rpos", "rid")).alias("by"))
    first = sets.groupBy("old").agg(F.min("by").alias("first"))
    clash = sets.join(first, "old").where("by <> first").select("old", F.col("first.rid").alias("first"), F.col("by.rid").alias("second"))
    return {"forks": members.select("old", "claimant", "last"), "resolved": whole.select("old", "resolver"), "conflicts": clash}
