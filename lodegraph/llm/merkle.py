"""Merkle manifest of a dataset, in DataFrame functions only: leaves per record, a tree per source, a tree over the sources.

A record's leaf hashes its fields, each with its length. In a source the leaves ascend by id, and every ``FANOUT``
consecutive nodes become their parent while there are several. A parent's children are spread into as many columns by
conditional aggregates (the slot pivot): the concatenated columns are hashed for the parent, and those left and right of a
child's own column are its siblings. Parents that were computed upwards hand the siblings down to their children, so
each row ends with the way to the root as an array of (left, right), one for each level of some thousand bytes.

Places in a source come from one range sort, whose pieces are counted, so a source of any size is spread; texts are hashed before
anything moves. The levels are a plan of fixed length, the logarithm of the largest source.

Defined cases: a null field is ``-``; null sources are one source, before all others; null ids come first and records of one
id follow by their leaves; an empty table has no rows; other columns are ignored; a single record is its own root, with no siblings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, placed

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_GROUP = ["known", "name"]


def joined_hash(parts: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """A field as ``-`` or its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, **changed: Column) -> Column:
    """The hash of a record, with ``changed`` fields in place of its own."""
    return joined_hash([encoded(changed.get(c, docs[c])) for c in FIELDS])


def _slots() -> list[Column]:
    return [F.max(F.when(F.col("slot") == i, F.col("item"))).alias(f"s{i}") for i in range(FANOUT)]


def parents(nodes: DataFrame) -> DataFrame:
    """(group, place, members, item with ``digest``) of one level -> its parents, with children in the columns s0, s1, ...

    ``members`` is the number of nodes of the group's level.
    """
    cut = nodes.withColumn("slot", F.col("place") % FANOUT).withColumn("place", F.floor(F.col("place") / FANOUT))
    spread = cut.groupBy(*_GROUP, "place").agg(F.max("members").alias("members"), *_slots())
    digest = F.sha2(F.concat_ws("", *[F.col(f"s{i}.digest") for i in range(FANOUT)]), 256)
    return spread.withColumn("members", F.floor((F.col("members") + FANOUT - 1) / FANOUT)).withColumn("digest", digest)


def _children(rows: DataFrame) -> DataFrame:
    """``parents`` with a ``path`` and what is ``above`` -> (group, place, item, path, above) of their children."""
    digests = [F.col(f"s{i}.digest") for i in range(FANOUT)]
    some = [
        F.when(F.col(f"s{i}").isNotNull(), F.struct(F.lit(i).alias("slot"), F.col(f"s{i}").alias("item"), F.concat_ws("", *digests[:i]).alias("left"), F.concat_ws("", *digests[i + 1 :]).alias("right")))
        for i in range(FANOUT)
    ]
    each = rows.select(*_GROUP, "place", "path", "above", F.explode(F.array_compact(F.array(*some))).alias("c"))
    here = F.array(F.struct(F.col("c.left").alias("left"), F.col("c.right").alias("right")))
    return each.select(*_GROUP, (F.col("place") * FANOUT + F.col("c.slot")).alias("place"), F.col("c.item").alias("item"), F.concat(here, "path").alias("path"), "above")


def _levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of parents above ``nodes``, and the top of each group: (group, level, digest)."""
    most = nodes.agg(F.max("members")).first()[0] or 0
    top = lambda rows, k: rows.where("members = 1").select(*_GROUP, F.lit(k).alias("level"), "item.digest")
    tops, levels, now = top(nodes, 0), [], nodes
    while most > 1:
        levels.append(materialise(parents(now.where("members > 1"))))
        now = levels[-1].select(*_GROUP, "place", "members", F.struct("digest").alias("item"))
        tops = tops.unionByName(top(now, len(levels)))
        most = -(-most // FANOUT)
    return levels, materialise(tops)


def _handed_down(levels: list[DataFrame], tops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group, place, item, path, above) of ``nodes``, from (group, level, path, above) of the tops."""
    at = lambda k: tops.where(F.col("level") == k).select(*_GROUP, F.lit(0).cast("long").alias("place"), "path", "above")
    paths, found = at(len(levels)), None
    for k in range(len(levels), 0, -1):
        below = _children(levels[k - 1].join(paths, [*_GROUP, "place"]))
        if k == 1:
            found = below
        paths = below.select(*_GROUP, "place", "path", "above").unionByName(at(k - 1))
    # a group of one has no level of its own
    lone = nodes.where("members = 1").join(at(0), [*_GROUP, "place"]).select(*_GROUP, "place", "item", "path", "above")
    return lone if found is None else found.unionByName(lone)


def folded(digest: Column, path: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, digest, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def proof(path: Column) -> Column:
    """The hash of all siblings on the way to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, path) of each record; ``tampered`` is the leaf that a check finds instead,
    null where it is as it was."""
    none = F.lit(None).cast("string")
    rows = docs.select(
        docs["source"].isNotNull().alias("known"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("name"), docs["doc_id"].alias("doc_id"),
        leaf(docs).alias("digest"), (none if tampered is None else tampered).alias("tampered"),
    )
    nodes = placed(rows, _GROUP, ["doc_id", "digest"]).select(*_GROUP, "place", "members", F.struct("digest", "doc_id", "tampered").alias("item"))
    nodes = materialise(nodes)
    levels, tops = _levels(nodes)

    # the sources are the leaves of one more tree
    named = tops.select(F.lit(True).alias("g"), F.col("known").alias("k"), F.col("name").alias("n"), "digest", "level")
    over = placed(named, ["g"], ["k", "n"]).select(F.lit(True).alias("known"), F.lit("").alias("name"), "place", "members", F.struct("digest", "k", "n", "level").alias("item"))
    over = materialise(over)
    upper, top = _levels(over)
    top = top.select(*_GROUP, "level", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("digest").alias("above"))
    sources = _handed_down(upper, top, over).select(
        F.col("item.k").alias("known"), F.col("item.n").alias("name"), F.col("item.level").alias("level"), "path", F.struct(F.col("item.digest").alias("subroot"), F.col("above").alias("root")).alias("above")
    )
    found = _handed_down(levels, materialise(sources), nodes)
    return found.select("item.doc_id", F.col("item.digest").alias("leaf"), "item.tampered", "above.subroot", "above.root", "path")


def changed_leaf(docs: DataFrame) -> Column:
    """The leaf of a record whose text's A-Z were lower-cased, for ids whose checksum 5 divides; null for others."""
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    low = F.translate(docs["text"].cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(hit, leaf(docs, text=low))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every record, some of them tampered with."""
    found = manifest(docs, changed_leaf(docs)).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
