"""Connected components of an undirected edge list, by alternating large-star and small-star steps.

Each step is one shuffle over the edges; nothing is gathered in the driver and a component may be of any size: a
star step keeps one edge per node, and a node's neighbours are only ever aggregated to their minimum. Every step is
written to the shared folder, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link each larger neighbour to the node's minimum. Small star: link the node and its
    smaller neighbours to their minimum."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(low, "a")
    if large:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).filter(F.col("a") != F.col("b")).distinct())


def components(edges: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """(node, component) of every node on an edge; the component is its smallest node. Raises if ``rounds`` do not
    suffice (they grow with the logarithm of the longest path)."""
    now = materialize(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
                      .filter(F.col("a") != F.col("b")).select("a", "b").distinct(), name)
    mark = None
    for _ in range(rounds):
        now = materialize(_star(_star(now, True), False), name)
        got = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2 ** 31)))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
