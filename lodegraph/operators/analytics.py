"""Usage and quality aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy(counts: DataFrame, count: str = "n") -> DataFrame:
    """One row (entropy): Shannon entropy of the shares over log2 of the number of groups, 0 for one group."""
    total = counts.agg(F.sum(count).alias("total"), F.count("*").alias("k"))
    share = F.col(count) / F.col("total")
    h = counts.crossJoin(F.broadcast(total)).agg(F.sum(-share * F.log2(share)).alias("h"), F.max("k").alias("k"))  # one row
    return h.select(F.when(F.col("k") > 1, F.col("h") / F.log2("k")).otherwise(0.0).alias("entropy"))


def type_bias(counts: DataFrame, count: str = "n") -> DataFrame:
    """Each group's deviation from an equal share, absolute and signed. One row per group stands in the window."""
    every = Window.partitionBy(F.lit(1))
    share, ideal = F.col(count) / F.sum(count).over(every), F.lit(1.0) / F.count("*").over(every)
    return counts.withColumn("signed", F.bround((share - ideal) / ideal, 3)).withColumn("bias", F.abs("signed"))


def histogram(rows: DataFrame, value: str, bounds: Sequence[float], *by: str) -> DataFrame:
    """(le, n): observations up to each bound, cumulative, counted in one pass; the sum and count stand beside."""
    counts = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds])
    rolled = rows.groupBy(*by).agg(counts.alias("buckets"), F.count(value).alias("count"))
    return rolled.select(*by, F.explode("buckets").alias("b"), "count").select(*by, "b.le", "b.n", "count")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 part / whole, 0 where the whole is 0."""
    return F.bround(F.coalesce(100.0 * part / F.nullif(whole, F.lit(0)), F.lit(0.0)), digits)


def worst(status: Column, order: Sequence[str]) -> Column:
    """The status of a group that comes last in ``order``."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), status)
    return F.max_by(status, rank)


def sessions(events: DataFrame, by: str, ts: str, gap_seconds: int) -> DataFrame:
    """Events with ``session``: its number within ``by``, a new one after a longer silence than the gap."""
    w = Window.partitionBy(by).orderBy(ts, "event_id")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    silence = at - F.lag(at).over(w)
    fresh = (silence.isNull() | (silence > gap_seconds * 1_000_000)).cast("int")
    return events.withColumn("__new", fresh).withColumn("session", F.sum("__new").over(w)).drop("__new")


def timeline(events: DataFrame, ts: str, width: str) -> DataFrame:
    """(start, n) of every bucket between the first and the last event, empty ones with 0."""
    counts = events.groupBy(F.window(ts, width).start.alias("start")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("start").alias("a"), F.max("start").alias("b"))
    grid = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {width}"))).alias("start"))
    return grid.join(counts, "start", "left").select("start", F.coalesce("n", F.lit(0)).alias("n"))
