"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node that can be reached, for all nodes with an edge.

    `edges` has two long columns u and v; order, repeats and loops do not matter. Every round
    hooks each neighbour to the least one, first upwards, then downwards, by a grouped minimum and
    a join; a hot node's rows are combined before the shuffle and split by skewed joins. Upwards
    only the centres of stars are hot; downwards a node has as many rows as it has stars.
    Rounds grow with the logarithm of the longest path. They end when the edges are stars: no node has
    two smaller neighbours, or a smaller and a larger one. Whether one has is all the driver learns.
    """
    edges = checkpointed(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written out, so that the join below shuffles it as a side of its own: only then are the
        # edges of a hot node, the centre of a large star, split over tasks.
        least = checkpointed(both.groupBy("u").agg(
            F.least(F.min("v"), F.first("u")).alias("m"),
            ((F.count_if(F.col("v") < F.col("u")) > 1)
             | ((F.min("v") < F.first("u")) & (F.max("v") > F.first("u")))).alias("open")))
        if least.where("open").isEmpty():
            break
        # larger neighbours of u hang on the least node around u
        upwards = both.where("v > u").join(least.select("u", "m"), "u")
        large = (upwards.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
                 .where("u <> v").distinct())
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        # so do u and its smaller neighbours
        small = (large.join(below, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(below.select("u", F.col("m").alias("v"))).distinct())
        edges = checkpointed(small)
    else:
        raise RuntimeError(f"no stars after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
