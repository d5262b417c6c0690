"""Nearest neighbours by collision counting over single-projection sorted arrays.

Index: vectors are dealt to blocks by a hash of their id; a block holds, for each of ``PROJECTIONS`` directions, its
vectors sorted by their projection. Directions are random and, as many as the dimensions allow, orthogonal to each
other: then a vector's collisions tell more of its distance than those of independent directions. Search: a query's own projections
are window centres; at radius R the window of each direction reaches ``WIDTH * R`` to both sides, and R grows by ``RATIO``
(virtual rehashing: windows only expand over the sorted arrays, nothing is hashed again). Each entry a window newly
covers is one collision of its vector; vectors with ``THRESHOLD`` of all directions are verified by their distance. A query is
done in a block when its k-th verified distance is within R, or all of the block is verified. No cap is set on candidates.

Each query searches its own block first. Its k-th distance there bounds what any other block can add, so those open their
windows up to that radius at once and stop. The k best of all blocks are the answer. Queries travel in chunks.

Defined cases: vectors that are null, zero, or with null or non-finite components take no part, nor do rows without
an id; vectors of different lengths have no distance, so each query searches those of its own; of repeated query ids the least
vector asks; a query's own id is never its neighbour; repeated rows are candidates each; fewer candidates than k
give fewer rows; an empty table gives an empty result; other columns are ignored. Recall and the share of vectors that is
verified are measured in the tests and stand in the README.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

PROJECTIONS = 96
WIDTH = 1.3
RATIO = 1.03
THRESHOLD = 0.78
#: The first radius: this part of the least distance among the first vectors of a block, dealt at random.
FIRST_LOOK, START = 256, 0.8
#: Vectors of a block on average, and queries of a chunk.
BLOCK, CHUNK = 16384, 512
INDEX = "d int, block long, ids binary, v binary, ord binary, h binary"


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, d, v): rows that take part, the vector in double precision and its length."""
    v = F.transform(vector, lambda x: x.cast("double"))
    usable = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return usable.where(finite & F.exists("v", lambda x: x != 0)).select("id", F.size("v").alias("d"), "v")


@lru_cache(maxsize=8)
def directions(d: int, m: int = PROJECTIONS, seed: int = 5) -> np.ndarray:
    """m directions of d dimensions, in groups of up to d that are orthogonal; a projection of a difference varies as one
    by a Gaussian direction would, with the length of the difference."""
    random = np.random.default_rng(seed)
    groups = [np.linalg.qr(random.standard_normal((d, d)))[0] * np.sqrt(d) for _ in range(-(-m // d))]
    return np.hstack(groups)[:, :m]


def sorted_arrays(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each direction the vectors' places by their projection, and the projections in order."""
    h = (v @ directions(v.shape[1])).T
    order = np.argsort(h, axis=1, kind="stable")
    return order.astype("<u4"), np.take_along_axis(h, order, 1).astype("<f4")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def index(vectors: DataFrame, blocks: int) -> DataFrame:
    """One row per block: ids, vectors, and the sorted arrays of all directions, as bytes."""

    def build(table: pa.Table) -> pa.Table:
        v = _matrix(table["v"]).astype("<f8")
        order, h = sorted_arrays(v)
        parts = {"ids": table["id"].to_numpy().astype("<i8"), "v": v, "ord": order, "h": h}
        head = {"d": pa.array([v.shape[1]], pa.int32()), "block": table["block"][:1].combine_chunks()}
        return pa.table(head | {k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in parts.items()})

    dealt = vectors.withColumn("block", _block(blocks))
    return dealt.groupBy("d", "block").applyInArrow(build, INDEX)


def _block(blocks: int):
    return F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long")


def search(
    ids: np.ndarray, v: np.ndarray, order: np.ndarray, h: np.ndarray, own: int, q: np.ndarray, k: int, bound: float = np.inf
) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, distances) of the k nearest of one block to ``q``, nearest first, ties to the smaller id, at most ``bound``
    away where that is given; and how many vectors were verified."""
    n, m = len(ids), len(h)
    centre = q @ directions(len(q))
    need = int(np.ceil(THRESHOLD * m))
    hits, distance = np.zeros(n, np.int64), np.full(n, np.nan)
    low = np.array([np.searchsorted(h[j], centre[j]) for j in range(m)])
    high = low.copy()
    radius = bound
    if not np.isfinite(bound):
        # windows are nested, so the first may be as wide as nearly all queries need: below the distance of the k-th
        seen = np.sqrt(((v[:FIRST_LOOK] - q) ** 2).sum(1))
        radius = max(START * float(seen[seen > 0].min(initial=seen.max())), 1e-9)
    allowed = ids != own
    while True:
        reach = WIDTH * radius * (1 + 1e-6)  # projections are kept in single precision
        covered = []
        for j in range(m):
            a, b = np.searchsorted(h[j], (centre[j] - reach - 1e-6, centre[j] + reach + 1e-6))
            a, b = min(a, low[j]), max(b, high[j])
            covered += [order[j, a : low[j]], order[j, high[j] : b]]
            low[j], high[j] = a, b
        hits += np.bincount(np.concatenate(covered), minlength=n)
        new = np.flatnonzero((hits >= need) & np.isnan(distance) & allowed)
        if len(new):
            distance[new] = np.sqrt(((v[new] - q) ** 2).sum(1))
        found = np.flatnonzero(~np.isnan(distance))
        full = (high - low).min() == n
        if full or radius >= bound or len(found) >= k and np.partition(distance[found], k - 1)[k - 1] <= radius:
            near = found[distance[found] <= bound]
            best = near[np.lexsort((ids[near], distance[near]))][:k]
            return ids[best], distance[best], len(found)
        radius *= RATIO


def bundled(queries: DataFrame, *by: str) -> DataFrame:
    """(id, d, v, home, bound) -> one row for each value of ``by``: the queries' columns as bytes."""
    kinds = {c: queries.schema[c].dataType.simpleString() for c in by}

    def bundle(table: pa.Table) -> pa.Table:
        parts = [table["id"].to_numpy().astype("<i8"), _matrix(table["v"]).astype("<f8"), table["home"].to_numpy().astype("<i8"), table["bound"].to_numpy().astype("<f8")]
        head = {c: table[c][:1].combine_chunks() for c in by}
        return pa.table(head | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("q_ids", "q_v", "q_home", "q_bound"), parts, strict=True)})

    return queries.groupBy(*by).applyInArrow(bundle, f"{', '.join(f'{c} {k}' for c, k in kinds.items())}, q_ids binary, q_v binary, q_home binary, q_bound binary")


def searched(pairs: DataFrame, k: int, home: bool) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block for the queries it meets, their own block's or all others'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                d, block, *parts = (batch.column(i)[r].as_py() for i in range(10))
                ids, v, order, h, q_ids, q_v, q_home, q_bound = (np.frombuffer(x, t) for x, t in zip(parts, ("<i8", "<f8", "<u4", "<f4", "<i8", "<f8", "<i8", "<f8"), strict=True))
                v, q_v, order, h = v.reshape(-1, d), q_v.reshape(-1, d), order.reshape(-1, len(ids)), h.reshape(-1, len(ids))
                for q, x, lives, bound in zip(q_ids, q_v, q_home, q_bound, strict=True):
                    if (lives == block) == home:
                        near, far, _ = search(ids, v, order, h, int(q), x, k, bound)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q)), pa.array(near), pa.array(far)], names=["query_id", "vec_id", "score"])

    columns = ("d", "block", "ids", "v", "ord", "h", "q_ids", "q_v", "q_home", "q_bound")
    return pairs.select(*columns).mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """For rows whose id is divisible by ``every``: query_id, rank, vec_id, score (Euclidean distance) of the k nearest."""
    vectors = materialise(valid(rows, key, vector))
    n = vectors.count()
    blocks = max(1, -(-n // block))
    built = index(vectors, blocks)
    asking = vectors.where(F.col("id") % every == 0).groupBy("id", "d").agg(F.min("v").alias("v")).withColumn("home", _block(blocks))
    # of a repeated id the least vector asks, whatever the lengths
    least = asking.groupBy("id").agg(F.min_by(F.struct("d", "v", "home"), F.col("v")).alias("q")).select("id", "q.*")
    open_ = least.withColumn("bound", F.lit(float("inf")))
    if blocks == 1:
        found = searched(built.join(bundled(open_.withColumn("block", F.col("home")), "d", "block"), ["d", "block"]), k, True)
    else:
        built, open_ = materialise(built), materialise(open_)
        own = materialise(searched(built.join(bundled(open_.withColumn("block", F.col("home")), "d", "block"), ["d", "block"]), k, True))
        bounds = own.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("score")).alias("limit"))
        chunks = max(1, -(-n // (every * CHUNK)))
        bounded = open_.join(bounds, "id", "left").withColumn("bound", F.coalesce("limit", "bound")).drop("limit")
        everywhere = bundled(bounded.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))), "d", "chunk")
        everywhere = everywhere.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        found = own.unionByName(searched(built.join(everywhere, ["d", "block"]), k, False))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
