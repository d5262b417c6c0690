"""Keyword, full-text, vector and hybrid search with rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def keyword_search(rows: DataFrame, query: str, columns: Sequence[str], limit: int | None = None, name: str = "name") -> DataFrame:
    """Rows with ``query`` in any of ``columns``, with their tier ``score``; best first, then by name and id."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | X.matches(F.col(c), query)
    found = rows.where(hit).withColumn("score", X.match_tier(F.col(name), query))
    return found.orderBy(F.desc("score"), name, "id").limit(limit) if limit else found


def with_rank(rows: DataFrame, *order: Column | str, rank: str = "rank") -> DataFrame:
    """Rank 1, 2, ... of a result list that a limit has bounded."""
    return rows.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def fuse(left: DataFrame, right: DataFrame, weight: float, k: int = 20, both: float = 0.015, top: float = 0.02, digits: int = 4) -> DataFrame:
    """Weighted reciprocal ranks of two ranked lists (name, rank, score): keyword results left, vector results right.

    A name in both lists gets ``both``; a keyword score of 60 or more gets ``top``.
    """
    a = left.select("name", F.col("rank").alias("kr"), F.col("score").alias("ks"))
    b = right.select("name", F.col("rank").alias("vr"))
    joined = a.join(b, "name", "full_outer")
    part = lambda r, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    bonus = F.when(F.col("kr").isNotNull() & F.col("vr").isNotNull(), both).otherwise(0.0) + F.when(F.col("ks") >= 60, top).otherwise(0.0)
    return joined.withColumn("rrf", F.bround(part("kr", 1 - weight) + part("vr", weight) + bonus, digits))


def boost(base: Column, namespace: Column, project: str, archived: Column, language: Column | None = None) -> Column:
    """1.5 for the project's own rows, 1.2 for its language, 0.3 for archived ones."""
    near = F.when(namespace == project, 1.5)
    if language is not None:
        near = near.when(language, 1.2)
    return F.bround(base * near.otherwise(1.0) * F.when(archived, 0.3).otherwise(1.0), 6)


def best_of_name(rows: DataFrame, name: str, *order: Column | str, alternatives: int = 2) -> DataFrame:
    """The best row of each name, with how many others there are and the ids of the next best."""
    w = Window.partitionBy(name).orderBy(*order)
    ranked = rows.withColumn("rn", F.row_number().over(w))
    kept = ranked.where(F.col("rn") <= 1 + alternatives).groupBy(name).agg(
        F.max_by(F.struct(*rows.columns), -F.col("rn")).alias("best"),
        F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.struct("rn", "id")))).alias("others"),
    )
    return kept.select("best.*", F.transform("others", lambda x: x["id"]).alias("alternatives"))


def capped(rows: DataFrame, by: str, value: str, most: int, out: str) -> DataFrame:
    """(by, out): the ``most`` least distinct values of each group, in order."""
    distinct = rows.select(by, value).distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy(value))
    return distinct.withColumn("rn", rank).where(F.col("rn") <= most).groupBy(by).agg(F.array_sort(F.collect_list(value)).alias(out))


def rerank(rows: DataFrame, words: Sequence[str], name: str, doc: str, kind: Column | None = None) -> DataFrame:
    """Three points for the share of query words in the name's words, one for those in the text."""
    q = X.strings(sorted(set(words)))
    share = lambda c: F.size(F.array_intersect(q, X.tokens(F.regexp_replace(F.col(c), "_", " ")))) / F.lit(float(len(set(words))))
    score = 3 * share(name) + share(doc)
    return rows.withColumn("rerank", score if kind is None else score * kind)
