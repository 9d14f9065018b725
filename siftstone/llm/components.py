"""Connected components by alternating stars, on tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import stage

ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least.hint("shuffle_hash"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them; edges have b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.hint("shuffle_hash"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node reachable.

    `edges` are pairs (a, b) of longs.  Each round makes a large-star and a
    small-star step and writes the edges down; it ends when a round changes
    nothing.  A hub costs a row per edge and partial minima, never a list.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    seen = None
    for _ in range(ROUNDS):
        now = stage(_small(_large(now).where("a <> b").distinct()).where("a <> b").distinct(), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
