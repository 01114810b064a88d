"""Connected components by alternating large-star and small-star steps, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import discard, materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v), u > v; the minimum of a node is pre-aggregated before its shuffle."""
    near = _both(edges) if large else edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    least = near.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
    joined = near.join(least, "x")
    if large:
        out = joined.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("y").alias("u"), F.col("m").alias("v")).union(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """``(id, component)`` of every node with an edge; the component is named by its smallest id.

    Edges are undirected; loops, repeats and null ends are ignored, an empty table gives an empty
    result. Ids may be of any ordered type. The rounds grow with the logarithm of the longest chain;
    each round is written to the shared folder, so a lost executor costs one round at most. A node's
    least neighbour is pre-aggregated; where the neighbours of one node are a large share of all edges,
    the adaptive skew join splits them, as only its least neighbour is on the other side.
    """
    a, b = F.col(src), F.col(dst)
    now = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    mark = None
    for _ in range(max_rounds):
        before, now = now, materialize(_step(_step(now, True), False), "stars")
        discard(before)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark:
            break
        mark = (seen.n, seen.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
