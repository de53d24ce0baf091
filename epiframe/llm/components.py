"""Connected components of an edge list, by alternating star steps on DataFrames.

The large-star step ties every neighbour that is greater than a node to the least node that it sees, the
small-star step does so for the smaller ones; both keep components and shorten paths, and a forest of stars
is reached after about log(nodes) rounds. Each round is two partial aggregations and two equi-joins, written
to the shared folder, so neither a hub's neighbours nor the edges of a component ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.llm.common import materialize


def _star(both: DataFrame, larger: bool) -> DataFrame:
    """(u, v) rows to (v, least neighbour of u): with ``larger``, for the neighbours above u; else for those
    at or below it."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if larger else met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges: root is the least node of its component."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    mark = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = materialize(_star(both, True), "components")  # u > v in every row
        e = materialize(_star(e, False), "components")
        seen = tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
