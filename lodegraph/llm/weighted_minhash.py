"""Document fingerprints by consistent weighted sampling.

Terms are lower-cased words with their occurrences as weights. For each of ``SAMPLES`` samples a term has two Gamma(2, 1)
variates r and c and a uniform b; with t = floor(ln w / r + b) its key is ln c - r (t - b) - r, and the sample is the term
of least key with its t. Two texts have equal samples with the probability of their generalised Jaccard similarity,
the sum of the smaller weights over the sum of the larger ones.

The variates of a term are rows of three seeded tables at places that different bits of the term's 64-bit hash name, so the
same term has the same ones everywhere and none are drawn a word. A sample is kept as 16 bits of a hash of term
and t; unequal samples agree by chance once in 65,536.

Defined cases: null text counts as empty; a text without words has the fingerprint of the sentinel sample, so empty texts
are alike to each other and to nothing else; rows that repeat id and text are one document in the order and come
back repeated, other texts of one id follow each other by a hash; rows without an id come first; an only document follows itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, text_column

SAMPLES = 64
TABLE_BITS = 13
SEED = 23
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b for each place and sample."""
    random = np.random.default_rng(SEED)
    shape = (1 << TABLE_BITS, SAMPLES)
    return (
        random.gamma(2.0, 1.0, shape).astype(np.float32),
        np.log(random.gamma(2.0, 1.0, shape)).astype(np.float32),
        random.random(shape).astype(np.float32),
    )


@lru_cache(maxsize=400_000)
def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), SEED)


def fingerprint(text: str) -> bytes:
    """SAMPLES little-endian 16-bit samples."""
    counts = Counter(text.lower().split())
    if not counts:
        return b"\0\0" * SAMPLES
    terms = np.fromiter(map(_hash, counts), np.uint64, len(counts))
    order = np.argsort(terms)  # ties between keys go to the smaller hash, whatever the words' order
    terms = terms[order]
    weight = np.log(np.fromiter(counts.values(), np.float32, len(counts)))[order]
    best = np.full(SAMPLES, np.inf, np.float32)
    chosen, step = np.zeros(SAMPLES, np.int64), np.zeros(SAMPLES, np.float32)
    r_table, c_table, b_table = tables()
    mask = np.uint64((1 << TABLE_BITS) - 1)
    columns = np.arange(SAMPLES)
    for at in range(0, len(terms), 1024):
        part = terms[at : at + 1024]
        r = r_table[part & mask]
        b = b_table[part >> np.uint64(TABLE_BITS) & mask]
        t = np.floor(weight[at : at + 1024, None] / r + b)
        key = c_table[part >> np.uint64(2 * TABLE_BITS) & mask] - r * (t - b + 1)
        least = key.argmin(0)
        value = key[least, columns]
        better = value < best
        best = np.where(better, value, best)
        chosen, step = np.where(better, least + at, chosen), np.where(better, t[least, columns], step)
    mixed = (terms[chosen] ^ (step.astype(np.int64).view(np.uint64) * _MIX)) * _MIX
    return (mixed >> np.uint64(48)).astype("<u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal samples of two fingerprints."""
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the following document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_COLUMNS = ("n_chars long", "edited_sha256 binary", "fingerprint binary", "edited_fingerprint binary", "near_edited double", "near_next double")


def _described(text: str, own: bytes, following: str, theirs: bytes) -> tuple:
    new = edited(text, following)
    changed = fingerprint(new)
    return len(text), hashlib.sha256(new.encode()).digest(), own, changed, likeness(own, changed), likeness(own, theirs)


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ranges of documents in ascending order of ids, each described with the one that follows it in its range.

    ``edge`` is null for those rows. The first document of a range and its last, whose follower isn't in the range,
    come as rows with ``edge`` 'first' and 'last', their ``text`` and, the last, its number of ``copies``.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), text_column(docs, text).alias("text"))
    ordered = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").select("doc_id", "text")
    names = ["doc_id", "part", "edge", "text", "copies", *(c.split()[0] for c in _COLUMNS)]
    kinds = [None, pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, id_kind = TaskContext.get().partitionId(), None, None
        nothing = (None,) * len(_COLUMNS)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k or id_kind) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            out, id_kind = [], batch.schema.field(0).type
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and held[:2] == (doc_id, x):
                    held = (*held[:3], held[3] + 1)
                    continue
                own = fingerprint(x)
                if held:
                    row = _described(held[1], held[2], x, own)
                    out += [(held[0], part, None, None, held[3], *row)]
                else:
                    out.append((doc_id, part, "first", x, 1, *nothing))
                held = (doc_id, x, own, 1)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([(held[0], part, "last", held[1], held[3], *nothing)])

    schema = f"doc_id {kind}, part int, edge string, text string, copies long, {', '.join(_COLUMNS)}"
    return materialise(ordered.mapInArrow(run, schema))


def range_ends(described: DataFrame) -> DataFrame:
    """The last document of each range, described with the first of the next range; the very last with the very first.

    There are two rows for each range here, not for each document.
    """
    kind = described.schema["doc_id"].dataType.simpleString()
    firsts = described.where("edge = 'first'").select("part", "text")
    after = firsts.select("part", F.lead("text").over(Window.orderBy("part")).alias("after"))
    start = firsts.select(F.min_by("text", "part").alias("start"))
    lasts = described.where("edge = 'last'").select("doc_id", "part", "text", "copies")
    pairs = lasts.join(after, "part").crossJoin(start).select("doc_id", "copies", "text", F.coalesce("after", "start").alias("following"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_described(x, fingerprint(x), y, fingerprint(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "copies", *(c.split()[0] for c in _COLUMNS)])

    return pairs.mapInArrow(run, f"doc_id {kind}, copies long, {', '.join(_COLUMNS)}")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    small_batches(docs.sparkSession)
    described = in_order(docs, key, text)
    inner = described.where("edge is null").drop("part", "edge", "text")
    every = inner.unionByName(range_ends(described))
    copies = every.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    text_of = lambda c: F.lower(F.hex(c)).alias(c)
    return copies.select("doc_id", "n_chars", text_of("edited_sha256"), text_of("fingerprint"), text_of("edited_fingerprint"), "near_edited", "near_next")
