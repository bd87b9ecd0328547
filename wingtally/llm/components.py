"""Connected components of a graph of links, by rounds of large and small stars.

Every round is two joins on a vertex and its least neighbour. Minima are summed
before a shuffle, and a join's hot vertex is split by the adaptive planner, so
one vertex may hold a third of all links. Each round is written to the shared
folder; the driver learns of a round whether all is settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Large stars (both): each larger neighbour of u goes to the least of u and its neighbours.
    Small stars: u and its smaller neighbours go to the least of them."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    out = near.join(least, near["u"] == least["c"])
    out = out.where(F.col("v") > F.col("u")) if both else out.unionByName(least.select(F.col("c").alias("u"), F.col("c").alias("v"), "c", "m"))
    return out.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u > v")


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge, to a root that has none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    return ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or (low = 1 and high = 1)").isEmpty()


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b), root the least node that it reaches. Nulls and loops are left out."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, name)
    for _ in range(rounds):
        if _settled(edges):
            break
        edges = written(_stars(_stars(edges, True), False).distinct(), name)
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
