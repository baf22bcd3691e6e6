"""Connected components of a graph whose edges live in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them; equal states of two rounds mean that nothing moved."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node reachable.

    Alternating large-star and small-star rounds, logarithmic in the longest path; each round's edges go to a
    checkpoint. A node's neighbours are never gathered: its least neighbour is an aggregate that is joined back, so a
    hub costs a skewed join, which adaptive execution splits. Self-loops and repeated edges do no harm; null ends are
    dropped. An empty graph gives no rows.
    """
    ordered = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = saved(ordered.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, state = None, _state(now)
    while state != before:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
