"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowfeat.llm.common import drop_stored, stored


def _mark(edges: DataFrame) -> tuple:
    """A count and an order-free sum that tell one set of edges from another."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` for every end of the undirected edges (`a`, `b`); the root is the smallest node of the component.

    Each step is an aggregate and a join on the node, so a hub of any degree is spread by partial aggregation and by
    adaptive splitting; no component is gathered in one place. Steps are stored, and the number of steps is
    logarithmic. No edges give no rows.
    """
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(current)
    while True:
        after = stored(_small_star(_large_star(current)))
        new = _mark(after)
        if new == mark:
            break
        drop_stored(current)
        current, mark = after, new
    drop_stored(current)
    # now every edge points from a node to its root
    own = after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stored(after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    low = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
