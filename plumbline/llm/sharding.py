"""Shards of near equal bytes that keep equal texts together: minimax contiguous partition.

Rows with the same text are one group, which is never split. Groups stand in
order of their smallest id and are cut into contiguous shards, so that the
largest shard is as small as it can be. The running sum of group sizes has one
end a group; a capacity is feasible if the greedy walk, each step to the last
end within the capacity, reaches the total in as many steps as there are shards.
Binary search finds the smallest feasible capacity, and the walk with it is the
cut.

A group heavier than an even share would leave the other shards to be filled up
to its own weight, so such giants (fewer than the shards) stand first, with a
shard each, and the method divides the rest.

All sums are distributed: groups are dealt to ranges of their order, each range
has its running sum and an offset. The search never reads all ends. It sees the
first and the last end of at most `cells` equal stretches and brackets the
capacity between a walk that may stop at known ends only and one that may stop
anywhere between ends that could have others between them. Both walks' stops
bound where a cut can fall, and the next round looks at finer stretches there
alone, until the bracket closes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

OVERHEAD = 16
KEY = ["text_a", "text_b", "n_bytes"]  # two hashes and the length: the group
BLOCK_BITS = 14
INDEX_BITS = 33  # of monotonically_increasing_id, within a partition


class Ends:
    """What is known of the ends of groups on the line from 0 to the total.

    A mark is a place on the line: an end, or the border of a part that was
    looked at. Behind an open mark, up to the next, there may be ends not known.
    """

    def __init__(self, total: int):
        self.total = total
        self.marks: dict[int, tuple[bool, bool]] = {0: (True, True)}  # place: is an end, is open
        self._order()

    def _order(self) -> None:
        self.at = sorted(self.marks)
        self.open = [self.marks[x][1] for x in self.at]
        self.known, self.most = [], []  # the last known end, the last possible end, up to each mark
        for i, x in enumerate(self.at):
            end = self.marks[x][0]
            self.known.append(x if end else self.known[-1])
            self.most.append(x if end or self.open[i - 1] else self.most[-1])

    def _mark(self, place: int) -> int:
        return bisect_right(self.at, place) - 1

    def learn(self, near: list[tuple[int, int]], seen: list[tuple[int, int, int]]) -> None:
        """Takes in the stretches (least end, largest end, number of ends) seen within `near`."""
        for low, high in near:
            beyond = self.open[self._mark(high)]
            for x in self.at[bisect_left(self.at, low) : bisect_right(self.at, high)]:
                del self.marks[x]
            self.marks[low - 1] = (self.marks.get(low - 1, (False, False))[0], False)
            self.marks[high] = (False, beyond)
        for low, high, n in seen:
            for x, more in ((low, n > 2), (high, False)) if high > low else ((low, False),):
                self.marks[x] = (True, more or self.marks.get(x, (False, False))[1])
        self._order()

    def unknown(self, low: int, high: int) -> bool:
        """Whether ends not known may lie from low to high."""
        return any(self.open[self._mark(low) : bisect_left(self.at, high)])

    def surely(self, limit: int) -> int:
        """The last known end up to the limit."""
        return self.known[self._mark(limit)]

    def perhaps(self, limit: int) -> int:
        """No end up to the limit lies beyond."""
        i = self._mark(limit)
        return limit if self.open[i] else self.most[i]

    def walk(self, last, capacity: int, shards: int) -> list[int]:
        at, found = 0, []
        for _ in range(shards):
            at = max(at, min(last(at + capacity), self.total))
            found.append(at)
        return found

    def smallest(self, last, low: int, high: int, shards: int) -> int:
        """The smallest capacity from low to high whose walk reaches the total; high does."""
        return low + bisect_left(range(low, high), True, key=lambda c: self.walk(last, c, shards)[-1] == self.total)


def stretches(groups: DataFrame, width: int, near: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(least end, largest end, number of ends) of each stretch of `width` bytes, of the ends within `near`."""
    inside = F.lit(False)
    for low, high in near:
        inside = inside | F.col("end").between(low, high)
    found = groups.where(inside).groupBy(F.expr(f"end div {width}L").alias("stretch"))
    return [tuple(r) for r in found.agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count("*").alias("n")).orderBy("stretch").drop("stretch").collect()]


def merged(near: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for low, high in sorted(near):
        if found and low <= found[-1][1]:
            found[-1] = (found[-1][0], max(high, found[-1][1]))
        else:
            found.append((low, high))
    return found


def cuts(groups: DataFrame, total: int, shards: int, cells: int = 1 << 16) -> list[int]:
    """The ends at which the walk with the smallest feasible capacity stops; the last is `total`.

    `groups` has the running sum `end` of sizes of 1 or more. A round collects
    at most some `cells` stretches, whatever the number of groups.
    """
    near, width = [(1, total)], max(1, -(-total // cells))
    low, high, ends = -(-total // shards), total, Ends(total)
    while True:
        ends.learn(near, stretches(groups, width, near))
        high = ends.smallest(ends.surely, low, high, shards)
        low = ends.smallest(ends.perhaps, low, high, shards)
        least, most = ends.walk(ends.surely, low, shards), ends.walk(ends.perhaps, high, shards)
        near = merged([(max(a, 1), b) for a, b in zip(least, most, strict=True) if ends.unknown(a, b)])
        if not near:
            return list(dict.fromkeys(ends.walk(ends.surely, high, shards)))
        width = max(1, min(width // 2, -(-sum(b - a + 1 for a, b in near) // cells)))


def giants(weights: list[int], total: int, shards: int) -> int:
    """How many of the heaviest groups, weights falling, take a shard each: those not lighter than an even share of what is left."""
    n = 0
    while n < min(len(weights), shards - 1) and weights[n] * (shards - n) >= total:
        total -= weights[n]
        n += 1
    return n


def _parts(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _offsets(dealt: DataFrame, part: Column, **sums: Column) -> DataFrame:
    """(part, a sum each over all parts before): as many rows as there are partitions, dealt by the session's settings."""
    each = dealt.groupBy(part.alias("part")).agg(*[s.alias(k) for k, s in sums.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(each.select("part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums]))


def running_ends(groups: DataFrame, order: list[str]) -> DataFrame:
    """groups with `end`, the running sum of `weight` in this order, a range of the order in a partition."""
    dealt = materialize(groups.repartitionByRange(_parts(groups), *order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("inside", F.sum("weight").over(within)).join(_offsets(dealt, F.col("part"), before=F.sum("weight")), "part")
    return summed.withColumn("end", F.col("inside") + F.col("before")).drop("inside", "before", "part")


def assign(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", cells: int = 1 << 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size is the text's UTF-8 bytes and 16; law is `bytes`, grown_shard null.
    Rows with equal texts share a shard; a null text counts as an empty one.
    Slots count from 0 in each shard, by group and doc_id. Groups stand by
    their smallest doc_id, those that have none last; repeated rows are members
    of their group like any other. Fewer groups than shards leave the last
    shards empty, an empty table gives an empty result, and other columns play
    no part. Ids may have any type that sorts.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(whole).cast("long").alias(KEY[2]), F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias(KEY[0]), F.xxhash64(F.lit(7), whole).alias(KEY[1]))
    rows = materialize(rows.withColumn("n", F.monotonically_increasing_id()).withColumn("block", F.shiftright("n", BLOCK_BITS)))
    size = F.col("n_bytes") + OVERHEAD
    blocks = materialize(rows.groupBy(*KEY, "block").agg(F.sum(size).alias("weight"), F.min("doc_id").alias("first")))
    groups = materialize(blocks.groupBy(*KEY).agg(F.sum("weight").alias("weight"), F.min("first").alias("first")))
    total = groups.agg(F.sum("weight")).first()[0] or 0
    order = [F.col("first").isNull().alias("nameless"), "first", *KEY]
    heaviest = groups.orderBy(F.desc("weight"), *order).limit(shards - 1).collect()
    alone = heaviest[: giants([g["weight"] for g in heaviest], total, shards)]
    own = docs.sparkSession.createDataFrame([(*(g[k] for k in KEY), i) for i, g in enumerate(alone)], ", ".join(f"{k} {t}" for k, t in [*rows.select(*KEY).dtypes, ("own", "int")]))
    rest = groups.join(F.broadcast(own), KEY, "left_anti")
    rest = materialize(running_ends(rest.withColumn("nameless", F.col("first").isNull()), ["nameless", "first", *KEY]))
    left = total - sum(g["weight"] for g in alone)
    stops = cuts(rest, left, shards - len(alone), cells) if left else []
    shard = F.lit(len(alone))
    for stop in stops[:-1]:
        shard = shard + (F.col("end") > stop).cast("int")
    placed = rest.select(*KEY, shard.alias("shard"), "end").unionByName(own.select(*KEY, F.col("own").alias("shard"), F.lit(0).cast("long").alias("end")))
    placed = blocks.select(*KEY, "block").join(placed, KEY)
    return _slots(rows.join(placed, [*KEY, "block"]), size)


def _slots(rows: DataFrame, size: Column) -> DataFrame:
    order = ["shard", "end", *KEY, F.col("doc_id").isNull(), "doc_id", "n"]
    dealt = rows.repartitionByRange(_parts(rows), *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.select("doc_id", size.alias("size"), "text_crc32", "shard", F.monotonically_increasing_id().alias("at")))
    part, inside = F.shiftright("at", INDEX_BITS), F.col("at").bitwiseAND(F.lit((1 << INDEX_BITS) - 1))
    counted = dealt.withColumn("part", part).join(_offsets(dealt, part, before=F.count("*")), "part").withColumn("place", inside + F.col("before"))
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n"))
    starts = sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return counted.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
