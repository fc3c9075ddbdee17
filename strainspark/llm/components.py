"""Connected components of an edge table, by alternating large and small stars.

Each round is two group-by minima and joins over the edges; nothing is collected
and no neighbour list is built, so a node of any degree is only a skewed join
key, which adaptive execution splits.  Rounds are cut by shared-folder tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainspark.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).union(moved).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for each node of ``edges(a, b)``; component is the smallest node reachable.

    Self loops and repeated edges are allowed, nulls are ignored; a node without
    edges is not returned.  An empty table gives an empty result.
    """
    current = scratch.keep(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").isNull().alias("n"), F.col("b").isNull().alias("k"))
        .filter("NOT n AND NOT k AND a <> b").select("a", "b").distinct(), f"{name}0")
    mark, step = None, 0
    while True:
        row = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if tuple(row) == mark or not row["n"]:
            break
        mark, step = tuple(row), step + 1
        following = scratch.keep(_small_star(_large_star(current)), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        current = following
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
