"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or itself)."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a < b").distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node reachable.

    Both stars keep the components and each pair of rounds shortens paths, so
    the number of rounds is logarithmic in the longest path. Edges stay in
    Spark; only a count and a checksum of them reach the driver. Without edges
    the result is empty. Null ends, loops and repeated edges are dropped.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialize(edges.where("a < b").distinct())
    state = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        edges = materialize(_small_star(_large_star(edges)))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
