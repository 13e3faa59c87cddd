"""Connected components by alternating large-star and small-star over staged edge tables.

Stars are joins and minima; a vertex with very many neighbours is combined before the shuffle, and its
join side is split by adaptive execution.  No edge or component reaches the driver, only two totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, ws: Workspace, name: str = "cc", rounds: int = 50) -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest node. edges: bigint u, v."""
    edges = edges.where("u <> v").select("u", "v").distinct()
    edges, seen = ws.stage(edges, f"{name}-0"), None
    for k in range(1, rounds + 1):
        edges = ws.stage(_small_star(_large_star(edges)), f"{name}-{k}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())
        ws.drop(f"{name}-{k - 1}")
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
