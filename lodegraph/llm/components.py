"""Connected components of an undirected graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Contraction rounds; the number needed grows with the logarithm of the longest path, so this is a guard only.
MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(neighbours: DataFrame) -> DataFrame:
    """Each edge with the least neighbour of ``u``; the aggregate combines before its shuffle, the join can be split."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m"))
    return neighbours.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links, self-links and repeats allowed -> (node, component), component being the least node reachable.

    Only nodes with a link to another node are returned. Each round points the larger neighbours of a node to its
    least one and then the smaller ones; hubs are handled by aggregate and join, never by collecting a
    neighbour list, and each round is written to the shared folder.
    """
    current = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _state(current)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_least(both)
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        pairs = _with_least(large)
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialise(small.unionByName(pairs.select("u", F.col("m").alias("v"))).distinct())
        after = _state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(roots).distinct()
