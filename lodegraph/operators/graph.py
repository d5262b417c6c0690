"""Bounded traversal, impact and structure of a directed graph of (src, dst, type) edges.

Traversals write the edges they join again and again to the shared folder first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

MAX_DEPTH = 4


def degrees(edges: DataFrame) -> DataFrame:
    """(id, fan_out, fan_in) by distinct neighbours; one shuffle of half-edges counts both."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("way"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.lit("in").alias("way"), F.col("src").alias("other")))).alias("e")).select("e.*").distinct()
    return ends.groupBy("id").agg(F.count_if(F.col("way") == "out").alias("fan_out"), F.count_if(F.col("way") == "in").alias("fan_in"))


def paths(edges: DataFrame, starts: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(start, node, length, chain) of all walks of up to ``depth`` edges that use no edge twice.

    ``depth`` is clamped to 1..MAX_DEPTH, so the plan is a fixed number of joins. An edge is its end points, and the
    chain of nodes tells which were used.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = stored(edges.select(F.col(a).alias("from"), F.col(b).alias("to")).distinct())
    walk = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("chain"))
    found = None
    for length in range(1, depth + 1):
        ahead = walk.join(step, F.col("node") == F.col("from"))
        if length > 2:  # the same edge again: its two ends stand side by side in the chain
            used = F.exists(F.sequence(F.lit(1), F.size("chain") - 1), lambda i: (F.element_at("chain", i) == F.col("from")) & (F.element_at("chain", i + 1) == F.col("to")))
            ahead = ahead.where(~used)
        walk = ahead.select("start", F.col("to").alias("node"), F.concat("chain", F.array("to")).alias("chain"))
        level = walk.withColumn("length", F.lit(length))
        found = level if found is None else found.unionByName(level)
    return found


def reach(edges: DataFrame, starts: DataFrame, depth: int, reverse: bool = False, chains: bool = False) -> DataFrame:
    """(start, node, distance): least distances up to ``depth``, the start itself left out; with ``chain``, the least of
    the shortest ways as an array of nodes, where ``chains`` asks for it.

    Level by level with one row per pair, so dense graphs don't multiply walks. The edges and each level are written
    once, so no level computes those before it again.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = stored(edges.select(F.col(a).alias("from"), F.col(b).alias("to")).distinct())
    seen = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("distance"))
    seen = seen.withColumn("chain", F.array("node")) if chains else seen
    front = seen
    for distance in range(1, max(1, min(depth, MAX_DEPTH)) + 1):
        joined = front.join(step, F.col("node") == F.col("from"))
        if chains:
            ahead = joined.select("start", F.col("to").alias("node"), F.concat("chain", F.array("to")).alias("chain")).groupBy("start", "node").agg(F.min("chain").alias("chain"))
        else:
            ahead = joined.select("start", F.col("to").alias("node")).distinct()
        front = stored(ahead.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(distance)))
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def impact_risk(direct, indirect, modules, data):
    """min(100, 15 direct + 5 indirect + 10 modules + 8 data) and its band."""
    score = F.least(F.lit(100), 15 * direct + 5 * indirect + 10 * modules + 8 * data)
    band = F.when(score >= 80, "CRITICAL").when(score >= 50, "HIGH").when(score >= 20, "MEDIUM").otherwise("LOW")
    return score, band


def size_term(lines):
    """Complexity by length: a tenth of the lines above 50, a twentieth above 20, else nothing."""
    return F.when(lines > 50, lines / 10.0).when(lines > 20, lines / 20.0).otherwise(0.0)
