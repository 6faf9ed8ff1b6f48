"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triptych.staging import drop_staged, staged


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that `edges` (u, v) links to a smaller one.

    Each large-star ties the larger neighbours of a node to the smallest, each small-star the
    smaller ones; edges are written after either, until each node has one edge, to a node that has
    none. Nodes that are the smallest of their component have no row.
    """
    state = staged(_larger_first(edges), "star-edges")
    while not _is_star(state):
        large = staged(_large_star(state), "star-large")
        small = staged(_small_star(large), "star-edges")
        drop_staged(state, large)
        state = small
    return state.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _is_star(edges: DataFrame) -> bool:
    several = edges.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a != b").select("u")
    onward = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return several.unionByName(onward).isEmpty()


def _larger_first(edges: DataFrame) -> DataFrame:
    return (
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _larger_first(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _larger_first(tied.unionByName(least.select("u", F.col("m").alias("v"))))
