"""Connected components of a graph given as edges, by large-star and small-star steps on DataFrames.

Every step groups by a node with partial sums only (minimum of the neighbours), so a hub with a third of all
edges is summed in the tasks that read it; the joins back are plain equi-joins that adaptive execution can split.
Each round is written to the shared folder.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Large star: every larger neighbour of u is tied to the least node near u.  Small star: u's smaller neighbours
    and u itself are."""
    if larger:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u")
    if larger:
        out = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge up, to a node that has none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("below")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("below")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("below").alias("below")).filter("up > 1 or (up = 1 and below = 1)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the least node) of every node that has an edge ``u``, ``v`` to another."""
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct())
    for _ in range(rounds):
        if _settled(edges):
            break
        edges = materialise(_star(_star(edges, True), False))
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    least = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least.select("node", F.col("node").alias("component")))
