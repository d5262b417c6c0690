"""Feedback folds: clamped weights, dual scores, co-use, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAIN, LOSS, TOP, BOTTOM = 0.2, 0.1, 2.0, 0.1


def clamped_weight(feedback: Column) -> Column:
    """Fold of an ordered boolean array from weight 1: +0.2 up to 2.0 for true, -0.1 down to 0.1 for false.

    The clamp makes the order matter, so this is a fold, not a sum.
    """
    step = lambda w, good: F.when(good, F.least(w + GAIN, F.lit(TOP))).otherwise(F.greatest(w - LOSS, F.lit(BOTTOM)))
    return F.aggregate(feedback, F.lit(1.0), step)


def step_map(good: Column) -> Column:
    """One feedback as a map x -> min(max(x + add, low), high)."""
    wide = F.lit(1e9)
    return F.struct(
        F.when(good, GAIN).otherwise(-LOSS).alias("add"), F.when(good, -wide).otherwise(BOTTOM).alias("low"), F.when(good, F.lit(TOP)).otherwise(wide).alias("high")
    )


def composed(maps: Column) -> Column:
    """An ordered array of such maps as one map: they are closed under composition, so parts of a log fold apart."""

    def then(f: Column, g: Column) -> Column:
        bound = lambda x: F.least(F.greatest(x + g["add"], g["low"]), g["high"])
        return F.struct((f["add"] + g["add"]).alias("add"), bound(f["low"]).alias("low"), bound(f["high"]).alias("high"))

    same = F.struct(F.lit(0.0).alias("add"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"))
    return F.aggregate(maps, same, then)


def folded_weights(log: DataFrame, key: str, order: list[str], good: Column) -> DataFrame:
    """(key, weight) of a whole feedback log: each key's days fold on their own, then the days of the key.

    A key with very many rows is spread over its days; what is gathered for a key is one map a day.
    """
    rows = log.select(key, F.to_date(order[0]).alias("day"), *order, step_map(good).alias("m"))
    day = F.array_sort(F.collect_list(F.struct(*order, "m")))
    days = rows.groupBy(key, "day").agg(composed(F.transform(day, lambda x: x["m"])).alias("m"))
    whole = F.array_sort(F.collect_list(F.struct("day", "m")))
    folded = days.groupBy(key).agg(composed(F.transform(whole, lambda x: x["m"])).alias("m"))
    return folded.select(key, F.least(F.greatest(1.0 + F.col("m.add"), F.col("m.low")), F.col("m.high")).alias("weight"))


def dual_score(positive: Column, negative: Column) -> Column:
    """(p - n / 2) / (p + n + 1)."""
    return (positive - 0.5 * negative) / (positive + negative + 1)


def co_use(rows: DataFrame, group: str, order: str, item: str, reach: int = 3) -> DataFrame:
    """(a, b, n): items of one group at most ``reach`` places apart, a before b; counts by look-ahead, without a join."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    later = F.array(*[F.lead(item, k).over(w) for k in range(1, reach + 1)])
    pairs = rows.select(F.col(item).alias("a"), later.alias("later")).select("a", F.explode("later").alias("b")).where("b is not null and a <> b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
