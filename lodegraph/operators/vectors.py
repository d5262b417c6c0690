"""A vector index: k-means cells as a partitioned table, searched by cosine, exactly or in the nearest cells only.

Centres are fitted on a sample of ``SAMPLE`` vectors at most (by a hash of their keys) and every vector is put into the cell of its
nearest centre, in a folder of its own. ``heads`` has each cell's centre, its members and its width: the widest angle between the centre
and a member. The angle between a query and any member is at least that to the centre less the width, so the k-th best
of the nearest cells rules out all cells that can't come up to it; what is left is read, and the answer is that of a scan.

Vectors without a length, of another size than the commonest, or with a component that is null or not finite have no cosine and are left out;
an index without vectors finds nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import stored

SAMPLE = 20_000
MOST_CELLS = 1024
ROUNDS = 12
#: Cells that a search reads first, or only.
PROBED = 4
#: Room for rounding in the bounds, as an angle.
_SLACK = 1e-6


def centres(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centres of unit vectors by Lloyd's rounds; a cell that loses all members keeps its centre."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        of = (sample @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(length > 0, sums / np.where(length > 0, length, 1), found)
    return found


class VectorIndex:
    """The index in ``folder``: ``cells`` partitioned by cell, and ``heads``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def build(self, rows: DataFrame, key: str, vector: str, cells: int | None = None) -> VectorIndex:
        whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
        sized = rows.where(F.col(key).isNotNull() & whole).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
        # one length: the commonest
        most = sized.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        if most is None:
            sized.select("key", "vector", F.lit(0.0).alias("angle"), F.lit(0).alias("cell")).write.parquet(f"{self.folder}/cells")
            self.spark.createDataFrame([], "cell int, n long, width double, centre array<double>").write.parquet(f"{self.folder}/heads")
            return self
        good = sized.where(F.size("vector") == most["dims"])
        n = most["count"]
        cells = cells or max(1, min(MOST_CELLS, int(n**0.5)))
        sample = good.where(F.pmod(F.xxhash64("key"), F.lit(n)) < SAMPLE).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").toPandas()["vector"]
        units = np.stack(sample.to_numpy()).astype(np.float64) if len(sample) else np.ones((1, most["dims"]))
        held = self.spark.sparkContext.broadcast(centres(units / np.linalg.norm(units, axis=1, keepdims=True), cells))

        @F.pandas_udf("cell int, angle double")
        def nearest(vectors: pd.Series) -> pd.DataFrame:
            x = np.stack(vectors.to_numpy()).astype(np.float64)
            near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ held.value.T
            return pd.DataFrame({"cell": near.argmax(1).astype("int32"), "angle": np.arccos(np.clip(near.max(1), -1, 1))})

        placed = good.withColumn("c", nearest("vector")).select("key", "vector", F.col("c.angle").alias("angle"), F.col("c.cell").alias("cell"))
        # a full cell may lie in several files, so it is no task of its own
        placed.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(8))).write.partitionBy("cell").parquet(f"{self.folder}/cells")
        heads = self.spark.read.parquet(f"{self.folder}/cells").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("width"))
        named = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(held.value)], "cell int, centre array<double>")  # MOST_CELLS at most
        heads.join(named, "cell").coalesce(1).write.parquet(f"{self.folder}/heads")
        return self

    def _cells(self, wanted: DataFrame) -> DataFrame:
        """The members of the cells that ``wanted`` names; the folders of others aren't opened."""
        cells = [r.cell for r in wanted.select("cell").distinct().collect()]  # MOST_CELLS at most
        return self.spark.read.parquet(f"{self.folder}/cells").where(F.col("cell").isin(cells))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(query, q, cell, near): the least angle between each query (query, q) and a member of each cell, by (cell's) centre and width."""
        heads = self.spark.read.parquet(f"{self.folder}/heads")
        each = queries.crossJoin(F.broadcast(heads))  # MOST_CELLS rows
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), X.cosine(F.col("centre"), F.col("q")))))
        return stored(each.withColumn("angle", angle).select("query", "q", "cell", "angle", F.greatest(F.lit(0.0), F.col("angle") - F.col("width") - _SLACK).alias("near")))

    def _scored(self, wanted: DataFrame) -> DataFrame:
        members = self._cells(wanted).select("cell", "key", "vector")
        return members.join(F.broadcast(wanted), "cell").select("query", "key", ((1 + X.cosine(F.col("vector"), F.col("q"))) / 2).alias("score"))

    def within(self, queries: DataFrame, least: float) -> DataFrame:
        """(query, key, score) of all vectors with (1 + cosine) / 2 of ``least`` or more."""
        reach = float(np.arccos(np.clip(2 * least - 1, -1, 1)))
        return self._scored(self.bounds(queries).where(F.col("near") <= reach)).where(F.col("score") >= least)

    def search(self, queries: DataFrame, k: int, least: float = 0.0, probed: int = PROBED, exact: bool = True) -> tuple[DataFrame, int]:
        """(query, key, score, rank) of the ``k`` nearest vectors of each query, equal scores by key, and how many cells were read.

        Without ``exact`` the ``probed`` nearest cells of a query are all that is read.
        """
        every = self.bounds(queries)
        place = F.row_number().over(Window.partitionBy("query").orderBy("angle", "cell"))
        first = stored(every.withColumn("place", place).where(F.col("place") <= probed).drop("place"))
        found, read = stored(self._scored(first)), first.count()
        if exact:
            kth = best(found, k).groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(0.0)).alias("least"))
            reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * F.greatest(F.coalesce("least", F.lit(0.0)), F.lit(least)) - 1)))
            rest = stored(every.join(first, ["query", "cell"], "left_anti").join(kth, "query", "left").where(F.col("near") <= reach + _SLACK).select("query", "q", "cell"))
            read += rest.count()
            found = found.unionByName(self._scored(rest))
        return best(found.where(F.col("score") >= least), k), read


def best(scores: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)


_BUILT: dict[tuple, str] = {}


def vector_index_of(spark: SparkSession, rows: DataFrame, key: str, vector: str, folder) -> VectorIndex:
    """The application's index of ``rows``, built on the first call and again when the files under ``rows`` are others."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    name = (spark.sparkContext.applicationId, key, vector, *files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first())
    if name not in _BUILT:
        _BUILT[name] = VectorIndex(spark, folder(spark)).build(rows, key, vector).folder
    return VectorIndex(spark, _BUILT[name])
