"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """``edges``: a, b. Returns node, root (the smallest node that it reaches) for every node with an edge.

    Alternating large-star and small-star steps: each joins every node's neighbours to the smallest
    one, so that trees get flatter until every edge leads to its root; the number of rounds grows
    with the logarithm of the largest component. A node's edges are never gathered: minima are
    aggregated in part before they move. Each round is written, and the last one but one deleted.
    Edges that are stars already, each led by its smallest node, need no round.
    """
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    for i in range(1, most_rounds):
        if _all_stars(e):
            break
        # Large star: every larger neighbour of a node points to the node's smallest neighbour or itself.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: smaller neighbours, and the node itself, point to the smallest one.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        e = scratch.save(small.distinct(), f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    # Of stars no centre is another's ray.
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _all_stars(e: DataFrame) -> bool:
    """Whether each node of the distinct edges (a > b) has one smaller neighbour, or only larger ones."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").isEmpty()
