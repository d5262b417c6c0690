"""Near-duplicate classes by SimHash fingerprints and pigeonring candidates.

Fingerprint: A-Z lower-cased, words are maximal runs outside ASCII white space, shingles are three consecutive words
joined by one space, repeats included (fewer words: the whole sequence; none or a null text: fingerprint zero). Each
shingle is hashed by XXH64 with seed 42; a bit is set if more than half of the hashes have it.

Links: fingerprints at most three bits apart. Four segments of 16 bits on a ring share a budget of 3, so some segment
starts a chain whose running sums stay within 3/4, 6/4, 9/4 and 12/4 bits, that is 0, 1, 2 and 3. Each fingerprint
is indexed by every pair of consecutive segments and probes with the second segment unchanged or one bit flipped, so
the join key already settles the first two links of the chain; the third link and the full distance follow. Where many
different fingerprints share two segments, those two bits apart or less are connected first, each through the
neighbours it shares, so that a dense group doesn't become all its pairs.

Defined cases: equal fingerprints are one class before any candidate is made, so a group of copies is one row; null
``doc_id`` rows get a class too (its least non-null id, null if there is none); repeated rows come back repeated;
an empty table gives an empty result; other columns are ignored (``near_duplicates``) or kept (``keep_earliest``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffled, small_batches, spread, text_column
from .components import connected_components

MAX_BITS = 3
#: Fingerprints with two segments in common from which a crowd is connected through stars.
CROWD = 64
SEGMENTS, SEGMENT_BITS = 4, 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text, unsigned."""
    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    n = max(1, len(words) - width + 1)
    return voted(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n))


def voted(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero without any."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, max(1, n // 4096)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): one row per document, the fingerprint as a signed 64-bit integer."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(F.col(key).alias("key"), text_column(docs, text).alias("text"))).mapInArrow(run, f"key {kind}, fp long")


def _segment(column: str, at):
    return F.shiftrightunsigned(F.col(column), at * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _starts(fps: DataFrame) -> DataFrame:
    """(fp, label, start, tag, second): the ring's four starts; start and first segment make the tag."""
    parts = fps.select("fp", "label", F.array(*[_segment("fp", i) for i in range(SEGMENTS)]).alias("s"))
    starts = parts.select("fp", "label", "s", F.explode(F.array(*[F.lit(i) for i in range(SEGMENTS)])).alias("start"))
    tag = F.col("start").cast("long") * (1 << 2 * SEGMENT_BITS) + F.expr("s[start]") * (1 << SEGMENT_BITS)
    return starts.select("fp", "label", "start", tag.alias("tag"), F.expr(f"s[(start + 1) % {SEGMENTS}]").alias("second"))


def crowded(fps: DataFrame, least: int | None = None) -> DataFrame:
    """The fingerprints that share a start and two segments with ``CROWD`` or more."""
    index = _starts(fps.withColumn("label", F.col("fp"))).select("fp", (F.col("tag") + F.col("second")).alias("key"))
    full = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= (CROWD if least is None else least)).select("key")
    return index.join(full, "key", "left_semi").select("fp").distinct()


def stars(fps: DataFrame) -> DataFrame:
    """(u, v): every two fingerprints at most two bits apart are connected through these links.

    Two such have a neighbour in common, so each goes to the least fingerprint of each of its 65 neighbours (itself
    included); all who meet at one are within two bits of each other, and a crowd of n gives n links there.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    near = fps.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("meet"))
    least = near.groupBy("meet").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("meet", "v")
    return near.join(shuffled(least), "meet").select(F.col("fp").alias("u"), "v").where("u <> v").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(fp, label) -> (u, v) with u < v, at most three bits apart and of different labels."""
    starts = _starts(fps)
    index = starts.select(F.col("fp").alias("v"), F.col("label").alias("v_label"), "start", (F.col("tag") + F.col("second")).alias("key"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(SEGMENT_BITS)])
    probes = starts.select(F.col("fp").alias("u"), F.col("label").alias("u_label"), "tag", "second", F.explode(flips).alias("flip")).select(
        "u", "u_label", (F.col("tag") + F.col("second").bitwiseXOR(F.col("flip"))).alias("key")
    )
    differ = F.expr("u ^ v")
    chain = F.expr(
        " + ".join(
            f"bit_count(shiftrightunsigned(u ^ v, cast((start + {i}) % {SEGMENTS} * {SEGMENT_BITS} as int)) & {(1 << SEGMENT_BITS) - 1})"
            for i in (1, 2)
        )
        + " <= 2"
    )
    # all conditions stand in the join, so only links are rows
    on = (probes["key"] == index["key"]) & (F.col("u") < F.col("v")) & (F.col("u_label") != F.col("v_label")) & chain & (F.bit_count(differ) <= MAX_BITS)
    return probes.join(shuffled(index), on).select("u", "v").distinct()


def all_links(fps: DataFrame) -> DataFrame:
    """Distinct ``fp`` values -> (u, v) links whose components are those of all pairs at most three bits apart.

    Crowds are connected through stars first; the join then makes no pairs inside what is connected already.
    """
    full = materialise(crowded(fps))
    if full.isEmpty():
        return links(fps.withColumn("label", F.col("fp")))
    near = materialise(stars(full))
    labels = connected_components(near).select(F.col("node").alias("fp"), F.col("component").alias("label"))
    labelled = fps.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))
    return links(materialise(labelled)).unionByName(near)


def classes(base: DataFrame, link: Callable[[DataFrame], DataFrame] = all_links) -> DataFrame:
    """(key, fp) rows -> (fp, component): the least key of the class that each fingerprint belongs to by ``link``."""
    fps = materialise(base.groupBy("fp").agg(F.min("key").alias("least")))
    comps = connected_components(link(fps.select("fp")))
    labelled = fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("label")
    )
    names = labelled.groupBy("label").agg(F.min("least").alias("component"))
    return materialise(labelled.join(names, "label").select("fp", F.col("component").alias("component")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (least id reachable)."""
    base = materialise(fingerprints(docs, key, text))
    return base.join(classes(base), "fp").select(
        F.col("key").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def keep_earliest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the least of their class, with all columns as they were.

    Texts without words are one class like any other. Rows without an id stay, and so do all rows that repeat the
    surviving id: an id names the row, not the copy.
    """
    return least_of_class(docs, near_duplicates(docs, key, text), key)


def least_of_class(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without those whose ``component_id`` in ``found`` is another id than theirs."""
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone.distinct(), docs[key] == F.col("__gone"), "left_anti")
