"""Evidence by content: a Merkle tree over ranges of a table's keys, and a diff of two revisions that goes into unequal ranges only.

A range of ``WIDTH`` keys is a leaf: its rows' hashes are summed in two words of 64 bits, so the order of rows doesn't matter and
sums combine before the shuffle, while each repeated row counts. A node hashes the places and digests of up to ``FANOUT`` children.
The tree is a table (group, level, place, rows, digest); level 0 has the leaves and each group's highest level one root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

WIDTH = 64
FANOUT = 16
#: Levels above the leaves: ranges for keys below WIDTH * FANOUT ** LEVELS; more keys make more levels.
LEVELS = 5

#: Rows of a group whose tree one task builds, at most.
WHOLE = 1_000_000


def _hashed(rows: DataFrame, group: Sequence[str], key: str, content: Sequence[str]) -> DataFrame:
    """(group, place, a, b): each row's range and the two words of its hash."""
    fields = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in content]
    digest = F.sha2(F.concat(*fields), 256)
    word = lambda at: F.conv(F.substring("h", at, 16), 16, 10).cast("decimal(20,0)")
    return rows.select(*group, F.floor(F.col(key) / WIDTH).alias("place"), digest.alias("h")).select(*group, "place", word(1).alias("a"), word(17).alias("b"))


def _summed(hashed: DataFrame, group: Sequence[str]) -> DataFrame:
    summed = hashed.groupBy(*group, "place").agg(F.count("*").alias("rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    full = F.lit(str(1 << 64)).cast("decimal(38,0)")
    parts = [F.col("rows").cast("string"), *[(F.col(c).cast("decimal(38,0)") % full).cast("decimal(20,0)").cast("string") for c in ("a", "b")]]
    return summed.select(*group, "place", "rows", F.sha2(F.concat_ws(":", *parts), 256).alias("digest"))


def leaves(rows: DataFrame, group: Sequence[str], key: str, content: Sequence[str]) -> DataFrame:
    """(group, place, rows, digest) of each range of keys that has rows; ``content`` is what a row is hashed by."""
    return _summed(_hashed(rows, group, key, content), group)


def _above(now: DataFrame, group: Sequence[str]) -> DataFrame:
    """The next level: (group, place, rows, digest)."""
    child = F.struct((F.col("place") % FANOUT).alias("slot"), "digest")
    up = now.groupBy(*group, F.floor(F.col("place") / FANOUT).alias("place")).agg(F.sum("rows").alias("rows"), F.array_sort(F.collect_list(child)).alias("c"))  # FANOUT at most
    text = F.array_join(F.transform("c", lambda x: F.concat(x["slot"].cast("string"), F.lit(":"), x["digest"])), ",")
    return up.select(*group, "place", "rows", F.sha2(text, 256).alias("digest"))


def tree(rows: DataFrame, group: Sequence[str], key: str, content: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """All nodes: (group, level, place, rows, digest)."""
    now = stored(leaves(rows, group, key, content))
    found = now.withColumn("level", F.lit(0))
    most = now.agg(F.max("place")).first()[0] or 0
    level = 0
    while level < levels or most >= 1:
        level, most = level + 1, most // FANOUT
        now = stored(_above(now, group))
        found = found.unionByName(now.withColumn("level", F.lit(level)))
    return found.select(*group, "level", "place", "rows", "digest")


def roots(nodes: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, rows, digest) of each tree's root."""
    return nodes.groupBy(*group).agg(F.max_by(F.struct("rows", "digest"), "level").alias("r")).select(*group, "r.*")


def roots_of(rows: DataFrame, group: Sequence[str], key: str, content: Sequence[str], levels: int = LEVELS, whole: int = WHOLE) -> DataFrame:
    """``roots`` of ``tree`` where only they are wanted: (group, rows, digest).

    Groups of up to ``whole`` rows have their tree built where the group's hashes are, which move once; for larger ones, each of
    whose levels is spread, the tree is written.
    """
    most = rows.agg(F.max(F.floor(F.col(key) / WIDTH))).first()[0] or 0
    large = stored(rows.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > whole).select(*group))
    some = None if large.isEmpty() else F.broadcast(large)  # one row for ``whole`` rows or more
    same = lambda of: [of[c].eqNullSafe(some[c]) for c in group]
    small = rows if some is None else rows.join(some, same(rows), "left_anti")
    now, level = _summed(_hashed(small, group, key, content).repartition(*group), group), 0
    while level < levels or most >= 1:
        level, most = level + 1, most // FANOUT
        now = _above(now, group)
    found = now.select(*group, "rows", "digest")
    return found if some is None else found.unionByName(roots(tree(rows.join(some, same(rows), "left_semi"), group, key, content, level), group))


def differing(old: DataFrame, new: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, first, last, old_rows, new_rows) of the ranges whose content differs: from the roots down, the children of unequal nodes only.

    Both are ``tree`` with as many levels or not: a root is compared at the higher tree's level, where the lower has none.
    """
    top = max(n.agg(F.max("level")).first()[0] or 0 for n in (old, new))
    wanted = None
    for level in range(top, -1, -1):
        a, b = (n.where(F.col("level") == level).select(*group, "place", F.col("rows").alias(f"{x}_rows"), F.col("digest").alias(f"{x}_digest")) for n, x in ((old, "old"), (new, "new")))
        if wanted is not None:
            under = lambda n: n.withColumn("parent", F.floor(F.col("place") / FANOUT)).join(wanted, [*group, "parent"], "left_semi").drop("parent")  # noqa: E731, B023
            a, b = under(a), under(b)
        unequal = stored(a.join(b, [*group, "place"], "full_outer").where(~F.col("old_digest").eqNullSafe(F.col("new_digest"))))
        wanted = unequal.select(*group, F.col("place").alias("parent"))
    return unequal.select(
        *group, (F.col("place") * WIDTH).alias("first"), (F.col("place") * WIDTH + WIDTH - 1).alias("last"), F.coalesce("old_rows", F.lit(0)).alias("old_rows"), F.coalesce("new_rows", F.lit(0)).alias("new_rows")
    )
