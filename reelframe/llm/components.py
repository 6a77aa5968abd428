"""Connected components of an edge table by alternating large and small stars, as in published work on MapReduce graphs.

Defined results: edges from a node to itself and repeated ones are left out, so a node without another has no row; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import cut, meet


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge up at most, and none that has one has another below it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of the edges (a, b) the smallest node that it can reach.

    Each round links every node to the smallest of its neighbours, first from below, then from above; a logarithmic
    number of rounds leaves stars around the smallest nodes.  Minima are taken by aggregation and reach a node with very
    many edges by a broadcast, so it costs no task more than others.  Each round is cut off in the shared folder.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _only_stars(edges):
        both, ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * edges.count()
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("_size"))
        large = meet(both, least, "u", ends).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_size"))
        moved = meet(large, least, "u", ends).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
