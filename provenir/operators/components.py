"""Connected components by alternating star steps (Kiveris et al., 2014), in O(log^2 n) rounds on any graph.

A large-star step hangs every larger neighbour of a vertex on the least vertex in its neighbourhood, a small-star
step every smaller one. Minima are aggregated before the exchange and nothing collects a neighbourhood, so a hub costs
no more than its edges. Each round is written to the shared folder, which cuts the lineage, and the one before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b, each once."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    hung = both.join(least, "a")
    if large:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """vertex, component (the least vertex reachable) for every end of edges(a, b); any orderable type, no nulls."""
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(max_rounds):
        stars = current.groupBy("a").count().where("count > 1").limit(1).isEmpty() and current.join(current.select(F.col("a").alias("b")), "b", "left_semi").limit(1).isEmpty()
        if stars:  # every vertex hangs on one that hangs on none
            break
        before, current = current, materialize(_star(_star(current, True), False), "cc")
        discard(before)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return current.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
