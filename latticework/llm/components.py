"""Connected components of a graph by randomised contraction, on tables.

In each round every vertex joins the vertex of least hash among itself and its neighbours, and the graph of those is kept;
a constant share of the vertices goes in each round, whatever the shape of the graph. Minima are pre-aggregated before the
shuffle; joins are left to the planner, which knows the sizes of the written tables and splits skewed sort-merge joins, so a
vertex with very many neighbours does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def connected_components(edges: DataFrame, source: str = "a", target: str = "b") -> DataFrame:
    """(id, component_id): for every vertex of an edge the least id of its component. Self links, repeated links and links with a null end change nothing."""
    e = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).filter("a <> b")
    e = shared.cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = None
    step = 0
    while not e.isEmpty():
        # By the ids themselves at first, which folds a star around its least id at once; then by ever new hashes.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct((F.xxhash64(c, F.lit(step)) if step else F.lit(0)).alias("h"), c.alias("v"))  # noqa: E731, B023
        least = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m")).select(F.col("a").alias("v"), F.least(F.col("m"), rank(F.col("a")))["v"].alias("to"))
        left = e.join(least.withColumnRenamed("v", "a"), "a").select(F.col("to").alias("a"), "b")
        left = left.join(least.withColumnRenamed("v", "b"), "b").select("a", F.col("to").alias("b")).filter("a <> b")
        old = names, e
        if names is None:
            names = shared.cut(least.select(F.col("v").alias("id"), "to"))
        else:
            names = shared.cut(names.join(least, names["to"] == least["v"], "left").select("id", F.coalesce(least["to"], names["to"]).alias("to")))
        e = shared.cut(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        shared.forget(*old)
        step += 1
    if names is None:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    smallest = names.groupBy("to").agg(F.min("id").alias("component_id"))
    return names.join(smallest, "to").select("id", "component_id")
