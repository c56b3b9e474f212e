"""Connected components of a graph of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.common import cut_lineage


def _points_down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller end; loops left out. One shuffle, which also serves groups and joins by a."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").repartition("a").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for each end of the edges (a, b).

    A large star links each node's larger neighbours to its smallest one, a small
    star its smaller ones; both keep components, and in a number of turns that grows
    with the logarithm of the longest path every node points at the smallest. The
    smallest neighbour is found by aggregation before the join, so a node with very
    many edges isn't gathered anywhere.
    """
    edges = cut_lineage(_points_down(edges))
    while True:
        # Done when each node points at one other only, and none of these points on.
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out = 1 AND into = 1").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = _points_down(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(_points_down(moved.unionByName(least.withColumnRenamed("m", "b"))))
