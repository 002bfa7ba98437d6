"""Connected components of an edge table, by alternating stars.

Every round points each node at smaller neighbours (large star, small star)
until all edges lead from a node to the smallest node of its component. The
edges stay distributed; the driver sees two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepset.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``u, v`` edges but the roots.

    ``component`` is the smallest node that can be reached. Loops, repeated
    edges and either direction are allowed; null ends are left out.
    """
    edges = (edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    edges, before = materialize(edges), None
    while (now := _digest(edges)) != before:
        before = now
        edges = materialize(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
