"""Connected components by alternating large-star and small-star steps.

Each step is a group-by of minima and a join, so a node with very many neighbours is no group in
memory; edges are written to the shared folder after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise

MAX_ROUNDS = 60


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of every node that has an edge. ``edges``: u, v long."""
    now = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = None
    for _ in range(MAX_ROUNDS):
        # Large star: hang each larger neighbour of u below the least of u and its neighbours.
        both = _neighbours(now)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: hang u's smaller neighbours, and u, below the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        new = materialise(small, "edges")
        was, sign = sign, new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(now)
        now = new
        if sign == was:
            break
    else:
        raise RuntimeError(f"components: no fixed point after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
