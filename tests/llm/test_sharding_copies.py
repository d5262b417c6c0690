"""Records that repeat very often, wide records, and how a shard's files lie."""

import glob
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import common, sharding


def test_many_copies_of_one_record(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 100)
    rows = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = rows.unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("other").alias("text")))
    got = sharding.assign(rows, 24, bucket_bytes=100_000)
    counts = got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m"), F.count_if(F.col("doc_id") == 7).alias("sevens")).collect()
    assert {r.n for r in counts} <= {30_500 // 24, 30_500 // 24 + 1} and sum(r.n for r in counts) == 30_500
    assert all(r.n == r.d == r.m + 1 and r.sevens > 1000 for r in counts)


def test_no_row_holds_all_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 10)
    rows = spark.createDataFrame([(1, 2, 1005), (3, 4, 2)], "h1 long, h2 long, copies long")
    got = sharding._spelled(rows).groupBy("h1").agg(F.count("*").alias("n"), F.min("copy").alias("a"), F.max("copy").alias("b"), F.countDistinct("copy").alias("d")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1005, 1, 1005, 1005), (3, 2, 1, 2, 2)]


@pytest.mark.parametrize("wide", [False, True])
def test_buckets_are_sized_by_whole_records(spark, wide):
    other = F.array_repeat(F.lit("x" * 50), 40) if wide else F.array(F.lit("x"))
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("tiny").alias("text"), other.alias("other"), F.lit(None).cast("binary").alias("raw"))
    size = rows.agg(F.sum(sharding._measured(rows)).alias("n")).first().n
    assert (size > 2000 * 2000) == wide
    path = common.shared_dir(spark)
    assert sharding.write_shards(rows, path, 3, bucket_bytes=50_000).count() == 2000


def test_files_of_a_shard_follow_each_other(spark):
    path = common.shared_dir(spark)
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text")).repartition(8)
    sharding.write_shards(rows, path, 4, bucket_bytes=20_000)
    shards = {}
    for f in glob.glob(path.removeprefix("file://") + "/shard=*/part-*.parquet"):
        slots = pq.ParquetFile(f).read(["slot"])["slot"].to_pylist()
        assert slots == sorted(slots)
        shards.setdefault(f.split("shard=")[1].split("/")[0], []).append((int(re.search(r"part-(\d+)", f)[1]), slots[0], slots[-1]))
    assert len(shards) == 4
    for parts in shards.values():
        ordered = sorted(parts)
        assert [p[1:] for p in ordered] == sorted(p[1:] for p in parts)
        assert all(a[2] + 1 == b[1] for a, b in zip(ordered, ordered[1:], strict=False))


def test_token_files_in_a_compressing_session(spark):
    """Files are as they are written, whatever the session compresses; rows without an id are dealt by their texts."""
    import public_tokenizers

    from lodegraph.llm import token_store

    rows = [(None, f"text number {i}") for i in range(300)] + [(5, "a b"), (5, "c d")]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.output.fileoutputformat.compress", "true")
    try:
        got = token_store.stored_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), public_tokenizers.path("word_bpe_49k.json"), 2).collect()
    finally:
        conf.unset("mapreduce.output.fileoutputformat.compress")
    ordered = sorted(got, key=lambda r: r.start)
    assert len(ordered) == 302 and [r.start + r.n_tokens for r in ordered[:-1]] == [r.start for r in ordered[1:]]
    assert [r.doc_id for r in ordered[-2:]] == [5, 5]


def test_a_document_of_very_many_lines(spark):
    import time

    from lodegraph.llm import line_dedup

    lines = [f"line {i // 2} of many words in here" for i in range(20_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    began = time.time()
    text = line_dedup.dedup_lines(docs).first().text
    # lines one word from an earlier one go as well, so the first is all that stays
    assert text == lines[0] and time.time() - began < 60
