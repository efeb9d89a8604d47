"""Connected components over an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opinara.storage import checkpointed


def _unsettled(e: DataFrame) -> DataFrame:
    """The nodes at which edges (u, v), u > v, are no star round its smallest node."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("larger")).union(e.select("v", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.min("larger").alias("least")).filter("larger > 1 OR larger > 0 AND least = 0")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Alternates the two star steps of Kiveris et al. (2014): each node links its
    larger neighbours to its smallest one, then all smaller neighbours and itself
    to the smallest. Edges never grow in number and the rounds are logarithmic in
    practice. A group is reduced to its minimum by an aggregate and joined back,
    never gathered. Null ends and self loops are ignored. Ends when the edges are stars
    round smallest nodes: every node is one edge's larger end or only a smaller one.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u"))
    e = checkpointed(e.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    while not _unsettled(e).isEmpty():
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        e = checkpointed(small.filter("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
