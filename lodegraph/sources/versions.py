"""A stored table with versions: merges rewrite the key ranges that they change only, and older versions stay readable.

``data/v=<version>/range=<i>`` holds the rows of one range as the version that wrote it left them; ``manifests/v=<version>`` has the
table's ranges, each with the version whose files are its rows. A manifest is written last, so a merge that failed is no
version, and the newest manifest is the table. Ranges are cut where the first version's keys are dense; beyond the last key lies the last range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 32


class VersionedTable:
    """The table in ``folder``, by a numeric ``key``."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: T.StructType):
        self.spark, self.folder, self.key, self.schema = spark, folder, key, schema

    def versions(self) -> list[int]:
        """The versions that are complete."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        base = path(f"{self.folder}/manifests")
        files = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(base)] if files.exists(base) else []
        return sorted(int(x[2:]) for x in names if x.startswith("v=") and files.exists(path(f"{self.folder}/manifests/{x}/_SUCCESS")))

    def manifest(self, version: int | None = None) -> list[tuple[int, str | None, int]]:
        """(range, the least key that isn't in it any more, version of its files) of a version, the newest if none is named."""
        version = self.versions()[-1] if version is None else version
        rows = self.spark.read.schema("range int, below string, held int").parquet(f"{self.folder}/manifests/v={version}")
        return sorted((r["range"], r.below, r.held) for r in rows.collect())  # a row for each range

    def _range(self, cuts: Sequence[str | None]) -> Column:
        kind = self.schema[self.key].dataType
        out = F.lit(len(cuts) - 1)
        for i in range(len(cuts) - 2, -1, -1):
            out = F.when(F.col(self.key) < F.lit(cuts[i]).cast(kind), i).otherwise(out)
        return out

    def _write(self, rows: DataFrame, cuts: Sequence[str | None], version: int, held: dict[int, int]) -> int:
        """Rows of whole ranges as files of ``version``; ranges not in ``held`` are this version's."""
        placed = rows.select(*self.schema.names).withColumn("range", self._range(cuts))
        placed.repartitionByRange("range", self.key).write.mode("overwrite").partitionBy("range").parquet(f"{self.folder}/data/v={version}")
        lines = [(i, cut, held.get(i, version)) for i, cut in enumerate(cuts)]
        self.spark.createDataFrame(lines, "range int, below string, held int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/v={version}")
        return version

    def create(self, rows: DataFrame, ranges: int = RANGES) -> int:
        """Version 0: ``rows`` cut into ``ranges`` of about as many rows."""
        shares = [i / ranges for i in range(1, ranges)]
        numeric = rows.select(F.expr(f"percentile_approx(`{self.key}`, array({', '.join(map(str, shares))}), 1000)").alias("q")).first()["q"] if ranges > 1 else []
        cuts: list[str | None] = sorted({x for x in numeric or []})
        return self._write(rows, [*map(str, cuts), None], 0, {})

    def read(self, version: int | None = None, ranges: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, of all ranges or of some; other ranges' files aren't opened."""
        lines = [x for x in self.manifest(version) if ranges is None or x[0] in ranges]
        wanted: dict[int, list[int]] = {}
        for i, _, held in lines:
            wanted.setdefault(held, []).append(i)
        fields = T.StructType([*self.schema.fields, T.StructField("range", T.IntegerType())])
        out = self.spark.createDataFrame([], self.schema)
        for held, some in wanted.items():
            part = self.spark.read.schema(fields).parquet(f"{self.folder}/data/v={held}").where(F.col("range").isin(some))
            out = out.unionByName(part.drop("range"))
        return out

    def merge(self, changes: DataFrame, combine: dict[str, Column] | None = None) -> int:
        """A new version in which each changed key has its new row; ``combine`` makes a column from ``old.<c>`` and ``new.<c>``, where
        both have the key, else the new row's counts. Only ranges with a changed key are read and written."""
        lines = self.manifest()
        cuts = [below for _, below, _ in lines]
        changes = changes.select(*self.schema.names)
        touched = sorted(r["range"] for r in changes.select(self._range(cuts).alias("range")).distinct().collect())  # ranges at most
        old, new = self.read(ranges=touched).alias("old"), changes.alias("new")
        both = old.join(new, F.col(f"old.{self.key}") == F.col(f"new.{self.key}"), "full_outer")
        fresh, known = F.col(f"new.{self.key}").isNotNull(), F.col(f"old.{self.key}").isNotNull()
        columns = [
            F.when(fresh & known, (combine or {}).get(c, F.col(f"new.{c}"))).when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in self.schema.names
        ]
        return self._write(both.select(*columns), cuts, self.versions()[-1] + 1, {i: held for i, _, held in lines if i not in touched})
