"""An append-only log with positions, as a streaming source with its own offsets.

``append`` writes rows as a segment ``segment=<first>-<last>`` whose rows have the positions ``seq`` from first to last; a segment
counts once Spark's committer has put its mark there. The source ``event_log`` reads positions from its offset up to the newest segment's end, in
parts of ``slice`` positions. Offsets are in the query's checkpoint: a batch whose handling failed is read again from the
same offsets when the query starts anew, and what is appended meanwhile comes in a later batch.

The source reads through pyarrow's file systems, so the log is in a folder that those and Spark both reach.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .scratch import stored

SLICE = 100_000


def _segments(folder: str) -> tuple[fs.FileSystem, list[tuple[int, int, str]]]:
    """(first, last, path) of the segments that are complete, in order."""
    store, base = fs.FileSystem.from_uri(folder)
    found = []
    for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if (m := re.fullmatch(r"segment=(\d+)-(\d+)", x.base_name)) and store.get_file_info(f"{x.path}/_SUCCESS").type == fs.FileType.File:
            found.append((int(m[1]), int(m[2]), x.path))
    return store, sorted(found)


def end(folder: str) -> int:
    """The position after the log's last row."""
    return max((last + 1 for _, last, _ in _segments(folder)[1]), default=0)


def append(rows: DataFrame, folder: str, order: Sequence[str]) -> int:
    """Add ``rows`` in their order as one segment; the position after its last row. No rows add no segment."""
    first = end(folder)
    # written once: ranges are sampled, so planned twice they need not begin at the same rows
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    n = ranged.count()
    if n:
        part = F.shiftright("__at", 33)
        # where each range begins is known from its count, a row for each range
        starts = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + first).alias("__shift"))
        placed = ranged.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("seq", F.col("__at") + F.col("__shift"))
        placed.drop("__at", "__part", "__shift").write.mode("overwrite").parquet(f"{folder}/segment={first}-{first + n - 1}")
    return first + n


@dataclass
class Positions(InputPartition):
    path: str
    start: int
    stop: int


class EventLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.folder, self.slice = options["path"], int(options.get("slice", SLICE))
        self.start, self.names = int(options.get("from", 0)), schema.names

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"next": max(self.start, end(self.folder))}

    def partitions(self, start: dict, stop: dict) -> Sequence[InputPartition]:
        parts = []
        for first, last, path in _segments(self.folder)[1]:
            a, b = max(first, start["next"]), min(last + 1, stop["next"])
            parts += [Positions(path, x, min(x + self.slice, b)) for x in range(a, b, self.slice)]
        return parts

    def read(self, partition: Positions) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        wanted = (ds.field("seq") >= partition.start) & (ds.field("seq") < partition.stop)
        yield from (x for x in ds.dataset(partition.path, format="parquet", filesystem=store).to_batches(columns=self.names, filter=wanted) if x.num_rows)


class EventLog(DataSource):
    """``spark.readStream.format("event_log")`` with the options path, fields (the schema as JSON), from and slice."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.options["fields"]))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return EventLogReader(self.options, schema)


def stream(spark: SparkSession, folder: str, schema: T.StructType, **options: object) -> DataFrame:
    """The log as a stream of the columns of ``schema`` and ``seq``."""
    spark.dataSource.register(EventLog)
    fields = T.StructType([*schema.fields, T.StructField("seq", T.LongType())])
    reader = spark.readStream.format("event_log").option("path", folder).option("fields", fields.json())
    for k, v in options.items():
        reader = reader.option(k.rstrip("_"), str(v))
    return reader.load()
