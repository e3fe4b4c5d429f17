"""Connected components of an edge table by alternating star operations.

Large-star and small-star rounds replace every edge by one to a smaller node until
each node points at the smallest node of its component.  A round is two grouped
minima and two joins on an even key; a node with very many edges is a skewed join,
which adaptive execution splits.  Nothing but two totals per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(low, "u")
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) with u > v -> (node, component) for every node but the smallest of each component.

    Self-edges and nulls are left out, repeated edges count once; an empty table has no components.
    """
    held = saved(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        held = saved(_small(_large(held)).distinct(), "edges")
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return held.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
