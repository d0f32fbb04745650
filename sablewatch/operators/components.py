"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): each
round is two joins on node minima, and rounds grow with the logarithm of the
component size, not with its diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m"))
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Is every node either a centre or tied to one centre and nothing else?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    ties = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ties.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node with an edge; the least node names it.

    Edges always point to the smaller node, so the centre of a star is its least.
    """
    current = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )
    while not _settled(current):
        current = cut_lineage(_small_star(_large_star(current)))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
