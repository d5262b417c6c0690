"""The log source with its offsets, failures of a consumer, and timers that act when nothing arrives."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodegraph.plans import ORACLE, QUERIES
from lodegraph.sources import event_log
from lodegraph.sources.scratch import folder
from lodegraph.streaming import streams as R

HOUR = datetime.timedelta(hours=1)
DAY = datetime.datetime(2024, 1, 1)


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def test_positions_follow_the_order_of_appends(spark):
    path = folder(spark)
    assert event_log.append(numbers(spark), path, ["v"]) == 0
    assert event_log.append(numbers(spark, 5, 3, 4).repartition(3), path, ["v"]) == 3
    assert event_log.append(numbers(spark, 1, 2), path, ["v"]) == 5
    got = spark.read.option("basePath", path).parquet(path).orderBy("seq").select("seq", "v").collect()
    assert [tuple(r) for r in got] == [(0, 3), (1, 4), (2, 5), (3, 1), (4, 2)]


def test_positions_are_whole_where_ranges_are_sampled(spark):
    path = folder(spark)
    rows = spark.range(0, 400_000, 1, 8).select((F.col("id") * 7919 % 400_000).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    assert event_log.append(rows, path, ["v"]) == 400_000
    assert spark.read.parquet(f"{path}/segment=0-399999").where("seq <> v").count() == 0


def test_positions_of_equal_events_follow_their_kind(spark, tmp_path):
    """Event ids that repeat leave no order open: query and SQL place their kinds alike."""
    duckdb = pytest.importorskip("duckdb")
    rows = spark.range(6000).select((F.col("id") % 500).alias("event_id"), (F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(F.col("id") % 28)).cast("timestamp_ntz").alias("ts"), F.element_at(F.array(*[F.lit(x) for x in "dbca"]), ((F.col("id") * 7 + F.col("id") / 500).cast("int") % 4 + 1)).alias("event_type"))
    rows.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["v08_polling_cursor"](spark, str(tmp_path)).select("event_type", "cursor", "newest", "handled").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT event_type, cursor, newest, handled FROM ({ORACLE['v08_polling_cursor']})").fetchall())


def test_a_failed_batch_comes_again_from_its_offset(spark):
    """The failure is raised; after the restart the same rows come under the same number, and later ones in a batch of their own."""
    path, checkpoint, schema = folder(spark), folder(spark), numbers(spark).schema
    handled, fail = [], {0: True, 1: True}

    def handle(rows, number):
        handled.append((number, sorted(r.seq for r in rows.collect())))
        if fail.pop(number, False):
            raise RuntimeError("the consumer failed")

    event_log.append(numbers(spark, *range(10)), path, ["v"])
    stream = lambda: event_log.stream(spark, path, schema, slice=3)
    with pytest.raises(Exception, match="the consumer failed"):
        R.consumed(stream(), handle, checkpoint)
    event_log.append(numbers(spark, *range(20, 25)), path, ["v"])
    R.consumed(stream(), handle, checkpoint)
    with pytest.raises(Exception, match="the consumer failed"):
        R.consumed(stream(), handle, checkpoint)
    R.consumed(stream(), handle, checkpoint)
    first, second = list(range(10)), list(range(10, 15))
    assert handled == [(0, first), (0, first), (1, second), (1, second)]
    R.consumed(stream(), handle, checkpoint)
    assert len(handled) == 4  # nothing new, nothing handled


def test_an_error_that_stays_is_raised_each_time(spark):
    path, checkpoint = folder(spark), folder(spark)
    event_log.append(numbers(spark, 1), path, ["v"])

    def broken(rows, number):
        raise ValueError("always")

    for _ in range(2):
        with pytest.raises(Exception, match="always"):
            R.consumed(event_log.stream(spark, path, numbers(spark).schema), broken, checkpoint)


def test_a_segment_without_its_mark_is_not_read(spark):
    path = folder(spark)
    event_log.append(numbers(spark, 1, 2), path, ["v"])
    numbers(spark, 3).withColumn("seq", F.lit(2).cast("long")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/segment=2-2")
    assert event_log.end(path) == 2


def test_a_stream_can_begin_at_a_position(spark):
    path, out = folder(spark), []
    event_log.append(numbers(spark, *range(6)), path, ["v"])
    R.consumed(event_log.stream(spark, path, numbers(spark).schema, from_=4), lambda rows, _: out.extend(r.v for r in rows.collect()), folder(spark))
    assert sorted(out) == [4, 5]


EVENT = "event_id long, ts timestamp, user_id long, event_type string"


def fed(spark, make, parts):
    """The rows that a stream gives out for parts that arrive one after the other, with a restart between them."""
    path, checkpoint, out = folder(spark), folder(spark), []
    spark.createDataFrame([], EVENT).write.parquet(path)
    for part in parts:
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(path)
        stream = make(spark.readStream.schema(EVENT).parquet(path), "1 hour")
        with R.state_in_rocksdb(spark):
            R.consumed(stream, lambda rows, _: out.extend(tuple(r) for r in rows.collect()), checkpoint, "update")
    return out


def test_a_lease_ends_without_another_event_of_its_job(spark):
    """Job 1 is claimed and never heard of again; another user's event lets the time pass, and the timer acts."""
    claim = [(3, DAY, 1, "click"), (4, DAY, 2, "click"), (7, DAY + 11 * HOUR, 2, "view")]
    later = [(9, DAY + 14 * HOUR, 3, "view")]
    last = [(12, DAY + 30 * HOUR, 3, "view")]
    out = fed(spark, R.leases, [claim, later, last])
    newest = {r[0]: r[1:] for r in out}
    assert ("running", 1, 0, 0) in [r[1:] for r in out if r[0] == 1]
    assert newest[1] == ("queued", 1, 1, 0)
    # the heartbeat of job 2 by its holder put off its end, so its lease ends later
    assert [r[1:] for r in out if r[0] == 2][-2:] == [("running", 1, 0, 0), ("queued", 1, 1, 0)]


def test_a_retry_comes_due_without_another_event(spark):
    """A failed delivery is retried three hours later; nothing of it comes, and its time is told all the same."""
    first = [(1, DAY, 1, "error"), (2, DAY + HOUR, 2, "view")]
    out = fed(spark, R.retries, [first, [(3, DAY + 3 * HOUR, 2, "view")], [(4, DAY + 9 * HOUR, 2, "view")]])
    of = [r[1:] for r in out if r[0] == 1]
    assert of[-1][:2] == ("retry", 1) and of[-1][-1] == 2 and ("retry", 1) in [r[:2] for r in of if r[-1] == 1]


def test_debounce_tells_when_it_is_quiet(spark):
    minute = datetime.timedelta(minutes=1)
    first = [(1, DAY, 1, "view"), (2, DAY + minute, 1, "view"), (3, DAY + 5 * minute, 1, "view")]
    quiet = [(4, DAY + 10 * HOUR, 2, "view")]
    out = fed(spark, R.debounced, [first, quiet])
    assert sorted(out) == [(1, 2), (1, 3)]


def test_neighbouring_keys_share_a_group(spark):
    """600 users are three calls of Python with state, not 600; what one does leaves the others as they are."""
    users = 600
    first = [(u, DAY + datetime.timedelta(minutes=u % 50), u, "click") for u in range(users)]
    out = fed(spark, R.leases, [first, [(users, DAY + 14 * HOUR, 7, "view")], [(users + 1, DAY + 40 * HOUR, users - 1, "view")]])
    newest = {r[0]: r[1:] for r in out}
    assert {u: newest[u] for u in range(users)} == {u: ("queued", 1, 1, 1 if u == 7 else 0) for u in range(users)}
    stream = R.leases(spark.readStream.schema(EVENT).parquet(folder_of(spark)), "1 hour")
    assert "bundle" in stream._jdf.queryExecution().analyzed().toString()


def folder_of(spark):
    path = folder(spark)
    spark.createDataFrame([], EVENT).write.parquet(path)
    return path
