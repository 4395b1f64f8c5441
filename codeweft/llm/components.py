"""Connected components by alternating large-star and small-star steps, each a join and a grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: greater neighbours point to the least neighbour; small: lesser neighbours and the node do."""
    ab, ba = edges.select("a", "b"), edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = ab.union(ba) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = near.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the least node of its component.

    ``edges`` has columns a, b of one type. Each round is written to the shared folder. Components of
    diameter d need about log d rounds; running out of them is an error, never a partial result.
    """
    now = pinned(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        now = pinned(_stars(_stars(now, True), False), "edges")
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
