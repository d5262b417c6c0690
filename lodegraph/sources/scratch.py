"""Tables that cut a lineage: written to the folder all executors share, never to a machine's own."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DROPPED: set[str] = set()


def folder(spark: SparkSession) -> str:
    """A new name below ``spark.checkpoint.dir``, in a folder of this application that goes when its driver ends.

    Where that setting is missing, a session on this machine alone uses a temporary folder; a cluster's is refused, as its
    executors don't share one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lodegraph.folder", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodegraph-")
        spark.conf.set("spark.lodegraph.folder", root)
    base = f"{root.rstrip('/')}/lodegraph/{spark.sparkContext.applicationId}"
    _drop_at_end(spark, base)
    return f"{base}/{uuid.uuid4().hex}"


def _drop_at_end(spark: SparkSession, base: str) -> None:
    """Let the file system delete the application's folder when the driver's JVM ends."""
    if base not in _DROPPED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _DROPPED.add(base)


def stored(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
