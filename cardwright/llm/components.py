"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    return (
        both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .filter("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _is_star(edges: DataFrame) -> bool:
    """Whether every node has one neighbour below it at most, and none above it then."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    odd = ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("up").alias("up")).agg(F.max((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))))
    return not odd.first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the
    smallest node reachable. Each round is written to the shared folder, so
    plans stay short and a lost executor costs one round; the last round leaves stars."""
    current = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc")
    while not _is_star(current):
        after = materialise(_small_star(_large_star(current)), "cc")
        release(current)
        current = after
    return (
        current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    )
