"""Near copies for the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words and shingles are those of ``simhash``, five words wide and hashed by XXH64. Candidates are found by its pigeonring join over
the SimHash fingerprints of the sets, at most three bits apart. Copies at 0.8 often differ in more bits, so those that share a band of
``ROWS`` min-hashes are candidates too, ``BANDS`` bands in all: a pair at 0.8 is one with a chance above 0.999 and a nearer one all but
surely. Every candidate is verified on the whole sets, so no link is below 0.8.

A band's bucket is first compared with one of its members, which connects a dense group in as many pairs as it has
members; while many are open in large buckets, some of them serve as further centres, which connects more in few pairs. Of
what is not connected then, buckets of ``CROWD`` or less give all pairs. In larger ones the members outside of the bucket's largest class
are compared with those of other classes whose prefix shares a shingle with theirs: in one order of all shingles, rare ones first,
sets of 0.8 or more have one in common among their first fifth, so no link of a candidate is lost, while texts that share
a frequent passage and differ else make no pair.

Defined cases: equal sets are one class before any candidate is made, texts without words among them; rows without an
id and rows that repeat the surviving id stay, as in ``simhash.keep_earliest``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffled, small_batches, spread, text_column
from .components import connected_components
from .simhash import LOWER, all_links, classes, least_of_class, voted

WIDTH = 5
BANDS, ROWS = 20, 5
CROWD, CENTRES = 32, 4
#: Rounds of further centres, at most, and the comparisons for each entry of the index that make another one worth it.
ROUNDS, EACH = 8, 2
_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
#: 0.8 or more: 5 |a & b| >= 4 |a | b|, in sizes of the sets.
_NEAR = "9 * size(array_intersect(a, b)) >= 4 * (size(a) + size(b))"
_SIZES = "5 * least({0}, {1}) >= 4 * greatest({0}, {1})"


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles in order; the whole sequence where it is shorter, none without words."""
    words = (text or "").encode("utf-8").translate(LOWER).split()
    if len(words) < width:
        parts: Iterator[bytes] = iter([b" ".join(words)] if words else [])
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """The keys of a set's bands, signed; none of an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[i : i + 4096, None] * _FACTORS + _SHIFTS).min(0), out=least)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, bands, shingles, sim): one row per document, ``fp`` being a hash of its set and ``sim`` the set's SimHash."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py()) for x in batch.column(1)]
            fps = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
            sims = np.array([voted(x) for x in found], np.uint64).view(np.int64)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps), pa.array([bands(x) for x in found], lists), pa.array([x.view(np.int64) for x in found], lists), pa.array(sims)],
                names=["key", "fp", "bands", "shingles", "sim"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = spread(docs.select(F.col(key).alias("key"), text_column(docs, text).alias("text")))
    return rows.mapInArrow(run, f"key {kind}, fp long, bands array<long>, shingles array<long>, sim long")


def _verified(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """The pairs (u, v) that are near, compared on their whole sets."""
    pairs = materialise(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    need = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    some = materialise(base.select("fp", "shingles").join(need, "fp", "left_semi").dropDuplicates(["fp"]))
    first, second = some.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), some.select(F.col("fp").alias("v"), F.col("shingles").alias("b"))
    return materialise(pairs.join(first, "u").join(second, "v").where(_NEAR).select("u", "v"))


def _sharing_prefixes(some: DataFrame, all_: DataFrame, base: DataFrame) -> DataFrame:
    """(u, v): sets of ``some`` and of ``all_`` (fp, n, label) of other classes that share a shingle of their prefixes."""
    members = materialise(all_.groupBy("fp").agg(F.first("n").alias("n"), F.first("label").alias("label")))
    asks = some.select("fp").distinct().withColumn("asks", F.lit(True))
    held = base.select("fp", "shingles").join(members.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles"))
    tokens = materialise(held.select("fp", F.explode("shingles").alias("token")))
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("fp").orderBy("often", "token"))
    first = tokens.join(often, "token").withColumn("place", place).join(members, "fp").where("often > 1 and place <= n - (4 * n + 4) div 5 + 1")
    first = materialise(first.select("fp", "token", "place", "n", "label").join(asks, "fp", "left"))
    u = first.where("asks").select("token", F.col("fp").alias("u"), F.col("place").alias("u_place"), F.col("n").alias("u_n"), F.col("label").alias("u_label"))
    # after the first shingle that both have, no more can be common than either has left
    left = "9 * (1 + least(u_n - u_place, n - place)) >= 4 * (u_n + n)"
    near = u.join(shuffled(first), "token").where(f"(asks is null or u < fp) and u_label <> label and {left} and " + _SIZES.format("u_n", "n"))
    return near.select("u", F.col("fp").alias("v"))


def by_fingerprint(base: DataFrame) -> DataFrame:
    """(u, v): candidates by SimHash. Sets of one fingerprint meet at the least of them, which stands for it in the pigeonring join."""
    sims = materialise(base.groupBy("fp").agg(F.first("sim").alias("sim")))
    heads = materialise(sims.groupBy("sim").agg(F.min("fp").alias("head")))
    alike = sims.join(heads, "sim").where("fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v"))
    first, second = heads.select(F.col("sim").alias("u"), F.col("head").alias("a")), heads.select(F.col("sim").alias("v"), F.col("head").alias("b"))
    apart = all_links(heads.select(F.col("sim").alias("fp"))).join(first, "u").join(second, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return alike.unionByName(apart)


def links(base: DataFrame) -> DataFrame:
    """``sets`` -> (u, v): links of near sets whose components are those of all near pairs."""
    index = base.groupBy("fp").agg(F.first(F.size("shingles")).alias("n"), F.first("bands").alias("bands"))
    index = materialise(index.select("fp", "n", F.explode("bands").alias("band")))

    def centre(i: int):
        # by the set alone, so that a group that meets in many bands has one centre in most of them, and each pair once
        return F.min(F.struct(F.xxhash64(F.lit(i), "fp").alias("h"), "fp", "n"))

    buckets = index.groupBy("band").agg(F.count("*").alias("members"), centre(0).alias("c")).where("members > 1")
    shared = materialise(index.join(buckets.select("band", "members", F.col("c.fp").alias("c"), F.col("c.n").alias("c_n")), "band"))
    central = shared.where("fp <> c and " + _SIZES.format("n", "c_n")).select(F.col("fp").alias("u"), F.col("c").alias("v"))
    near = _verified(by_fingerprint(base).unionByName(central), base)
    entries = index.count()
    for k in range(ROUNDS + 1):
        names = connected_components(near).select(F.col("node").alias("fp"), F.col("component").alias("label"))
        rest = materialise(shared.join(names, "fp", "left").select("band", "members", "fp", "n", "c", F.coalesce("label", "fp").alias("label")))
        many = rest.where(f"members > {CROWD}")
        sizes = many.groupBy("band", "label").agg(F.count("*").alias("size"))
        largest = sizes.groupBy("band").agg(F.max_by("label", F.struct("size", "label")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
        outside = materialise(many.join(largest, "band").where("label <> top").select("band", "members", "fp", "n", "label"))
        if k == ROUNDS or (outside.agg(F.sum("members")).first()[0] or 0) <= EACH * entries:
            break
        centres = outside.groupBy("band").agg(F.array(*[centre(1 + k * CENTRES + i) for i in range(CENTRES)]).alias("cs")).select("band", F.explode(F.array_distinct("cs")).alias("o"))
        apart = many.join(centres, "band").where("fp <> o.fp and " + _SIZES.format("n", "o.n")).select(F.col("fp").alias("u"), F.col("o.fp").alias("v"))
        more = _verified(apart, base)
        if more.isEmpty():
            break
        near = materialise(near.unionByName(more))

    few = rest.where(f"members <= {CROWD} and fp <> c")  # the centre is compared already
    mine = lambda rows: rows.select("band", F.col("fp").alias("u"), F.col("n").alias("u_n"), F.col("label").alias("u_label"))
    theirs = lambda rows: rows.select("band", "fp", "n", "label")
    differ = "u_label <> label and " + _SIZES.format("u_n", "n")
    pairs = mine(few).join(shuffled(theirs(few)), "band").where("u < fp and " + differ).select("u", F.col("fp").alias("v"))
    crossing = _sharing_prefixes(outside, many.join(largest.select("band"), "band", "left_semi"), base)
    return near.unionByName(_verified(pairs.unionByName(crossing), base))


def keep_earliest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the least of their class of near copies, with all columns as they were."""
    base = materialise(sets(docs, key, text))
    found = base.select("key", "fp").join(classes(base.select("key", "fp"), lambda _: links(base)), "fp")
    return least_of_class(docs, found.select(F.col("key").alias("doc_id"), F.col("component").alias("component_id")), key)
