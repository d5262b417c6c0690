"""Packing documents into sequences of at most ``capacity`` tokens by best fit over a length histogram.

Documents longer than ``capacity`` are cut into full pieces, their first piece being the rest; a piece is never cut
again. The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) is planned on the driver: lengths
from the longest on, each into the fullest open sequences that still take it, many equal sequences at a time. The plan
is runs of slots: so many pieces of this length go to consecutive sequences from number s on, at offset o. Pieces get
a rank within their length and take the slot of that rank by a join.

Ranks don't sort a length in one task: pieces are dealt to salted groups by a hash of their identity, ranked within
each group, and shifted by the sizes of the groups before.

Defined cases: null text counts as empty (one piece, the end id alone); repeated rows are pieces of their own; a null
``doc_id`` is kept; an empty table gives an empty result; other columns are ignored (they are not carried).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import tree_encoder
from .common import materialise, small_batches, spread, text_column

CAPACITY = 2048
#: Groups that share one length's ranking, at least; more so that a group of a length has some GROUP pieces.
SALTS, GROUP = 256, 65_536
#: Ranks that share a key of the join with the plan, and rows of the plan that a broadcast may have.
RANKS, BROADCAST_ROWS = 4096, 500_000


def pieces(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents, written to the shared folder."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tree_encoder(path).tree
        last = np.array([end], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            take: list[int] = []
            for i, x in enumerate(batch.column(1)):
                ids = np.concatenate([encode(x.as_py()), last])
                first = len(ids) % capacity or min(capacity, len(ids))
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    take.append(i)
                    rows.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = spread(docs.select(F.col(key).alias("doc_id"), text_column(docs, text).alias("text")))
    return materialise(rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first: runs (length, first rank, last rank + 1, first sequence, offset).

    Sequences with the same room are one entry, so each step places as many pieces as the smaller of two counts.
    """
    open_: dict[int, list[list[int]]] = defaultdict(list)  # room -> runs of sequences [first, count]
    rooms: list[int] = []  # sorted keys of open_
    runs, made = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                take, first, offset = left, made, 0
                if length * 2 <= capacity:  # further pieces of this length fit the same sequences
                    take = -(-left // (capacity // length))
                made += take
                room = capacity
            else:
                room = rooms[at]
                first, count = open_[room].pop()
                take = min(left, count)
                if count > take:
                    open_[room].append([first + take, count - take])
                if not open_[room]:
                    del open_[room], rooms[at]
                offset = capacity - room
            runs.append((length, rank, rank + take, first, offset))
            left, rank, room = left - take, rank + take, room - length
            if room:
                if room not in open_:
                    insort(rooms, room)
                open_[room].append([first, take])
    return runs


def ranked(rows: DataFrame, by: str, identity: list[str], salts: int = SALTS) -> DataFrame:
    """Add ``rank``: 0, 1, ... within each value of ``by``, in no order but the same on every run."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*identity), F.lit(salts)))
    counts = salted.groupBy(by, "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(by).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(by, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy(by, "__salt").orderBy(*identity)
    return (
        salted.withColumn("__own", F.row_number().over(own))
        .join(bases, [by, "__salt"])
        .withColumn("rank", F.col("__base") + F.col("__own") - 1)
        .drop("__salt", "__own", "__base")
    )


def pack(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = pieces(docs, path, end, capacity, key, text)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    schema = "length long, first long, until long, sequence long, offset long"
    runs = plan(histogram, capacity)
    slots = spark.createDataFrame(runs, schema)
    placed = ranked(cut, "length", ["doc_id", "piece", "ids_crc32", "start"], max(SALTS, -(-sum(histogram.values()) // GROUP)))
    # a run is met by its own ranks only, in blocks of them
    blocks = slots.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / RANKS), F.floor((F.col("until") - 1) / RANKS))))
    rows = sum((until - 1) // RANKS - first // RANKS + 1 for _, first, until, _, _ in runs)
    return (
        placed.withColumn("block", F.floor(F.col("rank") / RANKS))
        .join(F.broadcast(blocks) if rows <= BROADCAST_ROWS else blocks, ["length", "block"])
        .where("rank >= first and rank < until")
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
    )
