"""The vector index against a scan, in exact mode and by its nearest cells; and the stored table with versions."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.operators.vectors import VectorIndex
from lodegraph.sources.scratch import folder
from lodegraph.sources.versions import VersionedTable


def scores(x, q):
    return (1 + x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))) / 2


@pytest.fixture(scope="module")
def clustered(spark):
    """1,200 vectors around 30 directions, and their index."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(30, 16))[rng.integers(0, 30, 1200)] + 0.15 * rng.normal(size=(1200, 16))) * rng.uniform(0.1, 9, (1200, 1))
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, None] * 8), (5004, [1.0] * 3), (None, [1.0] * 16), (5005, [])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    frame = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    return x, VectorIndex(spark, folder(spark)).build(frame, "k", "v", cells=30)


def queries(spark, x, picks):
    return spark.createDataFrame([(str(i), x[i].tolist()) for i in picks], "query string, q array<double>")


def test_exact_search_equals_the_scan_and_reads_some_cells(spark, clustered):
    x, index = clustered
    picks = [3, 77, 500, 1100]
    found, read = index.search(queries(spark, x, picks), 10, probed=1)
    rows = found.collect()
    for i in picks:
        want = sorted(range(len(x)), key=lambda j: (-round(scores(x, x[i])[j], 12), j))[:10]
        assert [r.key for r in sorted((r for r in rows if r["query"] == str(i)), key=lambda r: r["rank"])] == want
    assert 4 <= read < 4 * 30 / 2  # of 30 cells a query


def test_nearest_cells_alone_find_most(spark, clustered):
    x, index = clustered
    picks = list(range(0, 1200, 40))
    found, read = index.search(queries(spark, x, picks), 10, probed=3, exact=False)
    rows = found.collect()
    hits = sum(len({r.key for r in rows if r["query"] == str(i)} & set(np.argsort(-scores(x, x[i]))[:10].tolist())) for i in picks)
    assert read == 3 * len(picks) and hits >= 0.9 * 10 * len(picks)


def test_threshold_search_equals_the_scan(spark, clustered):
    x, index = clustered
    got = {r.key for r in index.within(queries(spark, x, [9]), 0.9).collect()}
    assert got == set(np.flatnonzero(scores(x, x[9]) >= 0.9).tolist()) and len(got) > 5


def test_an_index_without_vectors_finds_nothing(spark):
    index = VectorIndex(spark, folder(spark)).build(spark.createDataFrame([(1, None), (2, [0.0])], "k long, v array<double>"), "k", "v")
    q = spark.createDataFrame([("a", [1.0, 2.0])], "query string, q array<double>")
    assert index.search(q, 3)[0].count() == 0 and index.within(q, 0.1).count() == 0


def files(path, version):
    found = glob.glob(f"{path.removeprefix('file://')}/data/v={version}/range=*/part-*")
    return {f: (os.path.getmtime(f), os.path.getsize(f)) for f in found}


def test_merge_rewrites_changed_ranges_only_and_keeps_versions(spark):
    path = folder(spark)
    old = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"), F.lit(1).alias("n"))
    table = VersionedTable(spark, path, "k", old.schema)
    assert table.versions() == []
    table.create(old, ranges=8)
    before = files(path, 0)
    changes = spark.createDataFrame([(3, "three", 5), (5000, "new", 7)], "k long, name string, n int")
    assert table.merge(changes, {"n": F.col("old.n") + F.col("new.n")}) == 1
    assert files(path, 0) == before
    assert {int(f.split("range=")[1].split("/")[0]) for f in files(path, 1)} == {0, 7}  # the first range and the last
    now = {r.k: (r.name, r.n) for r in table.read().collect()}
    assert len(now) == 1001 and now[3] == ("three", 6) and now[5000] == ("new", 7) and now[4] == ("n4", 1)
    assert {r.k: (r.name, r.n) for r in table.read(0).collect()} == {i: (f"n{i}", 1) for i in range(1000)}
    assert table.merge(spark.createDataFrame([(4, "four", 0)], "k long, name string, n int")) == 2
    assert [held for _, _, held in table.manifest()] == [2, *[0] * 6, 1] and table.versions() == [0, 1, 2]
    assert table.read(1).where("k = 4").first().name == "n4" and table.read().where("k = 4").first().name == "four"


def test_a_failed_merge_is_no_version(spark):
    path = folder(spark)
    old = spark.range(20).select(F.col("id").alias("k"), F.lit("x").alias("name"))
    table = VersionedTable(spark, path, "k", old.schema)
    table.create(old, ranges=2)

    @F.udf("string")
    def broken(_):
        raise ValueError("no merge")

    with pytest.raises(Exception, match="no merge"):
        table.merge(old.limit(3).withColumn("name", broken("name")))
    assert table.versions() == [0] and table.read().count() == 20
    assert table.merge(old.limit(3).withColumn("name", F.lit("y"))) == 1 and table.read().where("name = 'y'").count() == 3
