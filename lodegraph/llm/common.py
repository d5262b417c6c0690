"""What the operators of this subpackage share: scratch tables, batch sizes and prefix offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import folder

#: Rows an Arrow batch holds at most: whole texts are large, so far fewer than Spark's default.
BATCH_ROWS = 256
#: Bytes an Arrow batch holds at most, for runs of very long texts.
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all executors and the driver share; see ``sources.scratch``."""
    return folder(spark)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and outlives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers that take whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores where they lie in fewer partitions than there are: a small table in one file keeps one
    task busy. Larger tables stay as they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that shuffles both sides, never a broadcast. Spark sizes what comes out of an explode as what went in, and a table
    by its compressed files, so many times its threshold would go to the driver."""
    return rows.hint("merge")


def text_column(docs: DataFrame, name: str = "text") -> Column:
    """The text as a string, empty where null."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def prefix_offsets(counts: DataFrame, key: str, count: str, out: str, group: int = 1024) -> DataFrame:
    """Add ``out``: the sum of ``count`` over all smaller values of the integer ``key`` (one row per key).

    Two levels: totals per run of ``group`` keys are summed first, then each run on its own, so that no task sees all
    rows; the single-partition step has one row for each ``group`` keys.
    """
    runs = counts.withColumn("__run", F.floor(F.col(key) / group))
    totals = runs.groupBy("__run").agg(F.sum(count).alias("__total"))
    before = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("__run", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        runs.join(base, "__run")
        .withColumn(out, F.col("__base") + F.coalesce(F.sum(count).over(inside), F.lit(0)))
        .drop("__run", "__base")
    )


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` (0, 1, ... in the group's order), ``members`` (its rows) and ``__part``, a bounded piece of it.

    All rows are range-sorted by (group, order) and written once, so a group of any size lies in consecutive partitions;
    its pieces, one for each partition that it touches, are counted and their starts summed. Equal rows are told apart by a
    number of their own, so that they spread as well; which of them is first makes no difference. Columns of the group aren't null.
    """
    ranged = [*group, *order, "__salt"]
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())
    ordered = salted.repartitionByRange(*ranged).sortWithinPartitions(*ranged).drop("__salt").withColumn("__at", F.monotonically_increasing_id())
    held = materialise(ordered).withColumn("__part", F.shiftright("__at", 33))
    pieces = held.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    every = Window.partitionBy(*group)
    before = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        *group, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(every).alias("members")
    )
    return held.join(starts, [*group, "__part"]).withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__shift")
