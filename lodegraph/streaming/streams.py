"""Structured Streaming twins of the state operators.

A stream reads a log that arrives in parts, some of its rows out of order and late. ``drained`` appends one part after the
other and runs a query until it is used up, each time from the checkpoint in the shared folder; each micro-batch's changed rows are
written once under its number (a repeated batch overwrites its own folder, so the sink is idempotent), and the newest
row of each key is the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import queue_step, retry_step, suppression
from ..sources import event_log
from ..sources.bindings import Tables
from ..sources.scratch import folder


#: Parts in which the events arrive: by eight days each, but every tenth event two parts late.
ARRIVALS = 4


def arrival() -> Column:
    """The part that an event arrives in."""
    week = F.floor((F.dayofmonth("ts") - 1) / 8)
    return F.least(F.lit(ARRIVALS - 1), week + F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)).cast("int")


class Arrivals:
    """The events as a file stream whose files are appended part by part; ``ts`` is an instant."""

    def __init__(self, t: Tables):
        self.spark, self.events, self.path = t.spark, t.events, f"{folder(t.spark)}/arrivals"
        # an empty append makes the folder that the stream watches
        self.events.limit(0).write.parquet(self.path)
        stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1_000_000).parquet(self.path)
        self.stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))

    def part(self, part: int) -> DataFrame:
        return self.events.where(arrival() == part)

    def append(self, part: int) -> None:
        self.part(part).write.mode("append").parquet(self.path)


def drained(log: Arrivals, stream: DataFrame, keys: Sequence[str], mode: str = "update") -> DataFrame:
    """Run ``stream`` over all parts of the log and return the newest row of each key."""
    spark, base = stream.sparkSession, folder(stream.sparkSession)

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    for part in range(ARRIVALS):
        log.append(part)
        consumed(stream, keep, f"{base}/checkpoint", mode)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", f"{base}/rows").parquet(f"{base}/rows")
    columns = [c for c in stream.columns if c not in keys]
    if not columns:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("row")).select(*keys, "row.*")


def consumed(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand all that the stream has to ``handle(rows, batch)``, from the offset in ``checkpoint`` on; a batch's offset is saved after it is
    handled, so a batch whose handling failed comes again, with the same rows and number, when this runs anew. Errors are raised."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(availableNow=True).start().awaitTermination()


def polled(log: Arrivals, group: str, value: str) -> DataFrame:
    """(group, cursor, newest, handled) of a consumer that reads the log by positions: the last position and greatest value handled,
    and how many rows. A batch's rows are written under its number, so one that comes again replaces itself."""
    spark, base = log.spark, folder(log.spark)
    path = f"{base}/log"
    wanted = T.StructType([log.events.schema[group], log.events.schema[value]])
    kinds = T.StructType([*wanted.fields, T.StructField("seq", T.LongType()), T.StructField("batch", T.IntegerType())])

    def handle(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    for part in range(ARRIVALS):
        event_log.append(log.part(part).select(group, value), path, [value, group])  # rows alike in both are interchangeable
        consumed(event_log.stream(spark, path, wanted), handle, f"{base}/checkpoint")
    rows = spark.read.schema(kinds).option("basePath", f"{base}/rows").parquet(f"{base}/rows")
    return rows.groupBy(group).agg(F.max("seq").alias("cursor"), F.max(value).alias("newest"), F.count("*").alias("handled"))


#: Neighbouring keys that share a group: bounded, so a group's state is too, however many keys there are.
BUNDLE = 256


def _bundle(key: str) -> Column:
    return F.floor(F.col(key) / BUNDLE).alias("bundle")


class TimedFold(StatefulProcessor):
    """A fold over each key's events in the order of their times that also acts when nothing arrives.

    Events wait until the watermark has passed them, then no earlier one can come. ``step(state, *event)`` takes an event in; where
    ``due(state)`` names a time, ``lapse(state)`` is what becomes of the state then, before any event at or after it: a timer
    sees to it if none comes. Both return (state, row or None). With ``shown`` a row of the state follows each change.

    The group is a bundle of ``BUNDLE`` neighbouring keys, as Spark calls Python and its state once for each group; every key in it
    has a state and waiting events of its own.
    """

    def __init__(self, kinds: str, event: str, rows: str, start: tuple, step, due, lapse, shown=None):
        self.kinds, self.event, self.start = kinds, event, start
        self.names, self.columns = ([x.split()[0] for x in y.split(", ")] for y in (rows, event))
        self.step, self.due, self.lapse, self.shown = step, due, lapse, shown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states, self.waiting = handle.getListState("states", f"of long, {self.kinds}"), handle.getListState("waiting", f"of long, {self.event}")

    def _followed(self, state: tuple, events: list[tuple], mark: int) -> tuple[tuple, list[tuple]]:
        rows = []
        for e in [*events, None]:
            at = self.due(state)
            if at is not None and at <= (mark if e is None else e[0]):
                state, row = self.lapse(state)
                rows += [row] if row else []
            if e is not None:
                state, row = self.step(state, *e)
                rows += [row] if row else []
        return state, rows

    def _advance(self, arrived: dict[int | None, list[tuple]], mark: int) -> Iterator[pd.DataFrame]:
        states = {of: tuple(state) for of, *state in self.states.get()} if self.states.exists() else {}
        waiting = {of: [*events] for of, events in arrived.items()}
        for of, *event in self.waiting.get() if self.waiting.exists() else ():
            waiting.setdefault(of, []).append(tuple(event))
        rows, rest, times = [], [], []
        for of in {**states, **waiting}:
            before = state = states.get(of, self.start)
            events = sorted(waiting.get(of, ()))
            state, made = self._followed(state, [e for e in events if e[0] < mark], mark)
            later = [e for e in events if e[0] >= mark]
            states[of] = state
            rest += [(of, *e) for e in later]
            times += [t for t in (later[0][0] if later else None, self.due(state)) if t is not None]
            if self.shown and (state != before or of in arrived):
                made.append(self.shown(state))
            rows += [(of, *r) for r in made]
        self.states.put([(of, *state) for of, state in states.items()])
        if rest or self.waiting.exists():
            self.waiting.put(rest) if rest else self.waiting.clear()
        if times:
            self.handle.registerTimer(max(min(times) // 1000 + 1, mark // 1000 + 1))
        if rows:
            yield pd.DataFrame(rows, columns=self.names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived: dict[int | None, list[tuple]] = {}
        for frame in rows:
            for of, *event in frame[[self.names[0], *self.columns]].itertuples(index=False, name=None):
                arrived.setdefault(None if key[0] is None else of, []).append(tuple(event))  # keys that are null have a bundle of their own
        yield from self._advance(arrived, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance({}, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def timed(stream: DataFrame, key: str, event: dict[str, Column], fold: TimedFold, rows: str, delay: str) -> DataFrame:
    """``fold`` over the events of each key; the first column of an event is its time in microseconds."""
    marked = stream.withWatermark("ts", delay).select(_bundle(key), key, "ts", *[c.alias(k) for k, c in event.items()])
    return marked.groupBy("bundle").transformWithStateInPandas(statefulProcessor=fold, outputStructType=rows, outputMode="Update", timeMode="EventTime")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Timers need a state store that keeps its keys in order."""
    name, own = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, own)


#: Of the lease: microseconds. A debounced event stands once nothing has come for the gap.
GAP = 60 * 1_000_000


def lease_step(state: tuple, at: int, number: int, action: str, worker: int) -> tuple[tuple, None]:
    """A job whose lease ends by itself, else as ``queue_step``: (status, holder, until, attempts, expired, refused)."""
    return queue_step(state, at, number, action, worker), None


def lease_due(state: tuple) -> int | None:
    return state[2] if state[0] == "running" else None


def lease_lapse(state: tuple) -> tuple[tuple, None]:
    """The job is due again where its lease ended; whoever held it is refused from then on."""
    return ("queued", -1, state[2], state[3], state[4] + 1, state[5]), None


def leases(stream: DataFrame, delay: str) -> DataFrame:
    """(user_id, status, attempts, expired, refused) of each job."""
    rows = "user_id long, status string, attempts long, expired long, refused long"
    fold = TimedFold(
        "status string, holder long, until long, attempts long, expired long, refused long", "at long, id long, action string, worker long", rows,
        ("queued", -1, 0, 0, 0, 0), lease_step, lease_due, lease_lapse, lambda s: (s[0], s[3], s[4], s[5]),
    )
    kinds = {"signup": "enqueue", "click": "claim", "view": "heartbeat", "purchase": "complete", "error": "fail"}
    action = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    return timed(stream, "user_id", {"at": F.unix_micros("ts"), "id": F.col("event_id"), "action": action, "worker": F.col("event_id") % 3}, fold, rows, delay)


def retries(stream: DataFrame, delay: str) -> DataFrame:
    """(user_id, outcome, attempts, next_at, early, due) of each delivery; ``due`` counts how often its time came, which a worker is told
    of by a row, whether an event of the delivery follows or not."""
    rows = "user_id long, outcome string, attempts long, next_at long, early long, due long"

    def step(state: tuple, at: int, number: int, action: str | None) -> tuple[tuple, None]:
        after = retry_step(state[:4], at, number, action) if action else state[:4]
        return (*after, state[4] if after[:3] == state[:3] else 0, state[5]), None

    def due(state: tuple) -> int | None:
        return state[2] if state[0] in ("scheduled", "retry") and not state[4] else None

    def lapse(state: tuple) -> tuple[tuple, None]:
        return (*state[:4], 1, state[5] + 1), None

    fold = TimedFold(
        "outcome string, attempts long, next_at long, early long, told long, due long", "at long, id long, action string", rows,
        ("scheduled", 0, 0, 0, 0, 0), step, due, lapse, lambda s: (*s[:4], s[5]),
    )
    kinds = {"signup": "schedule", "click": "deliver", "error": "fail"}
    action = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    return timed(stream, "user_id", {"at": F.unix_micros("ts"), "id": F.col("event_id"), "action": action}, fold, rows, delay)


def debounced(stream: DataFrame, delay: str) -> DataFrame:
    """(user_id, event_id): the last event of each run of events not more than ``GAP`` apart, once nothing came for that long."""
    rows = "user_id long, event_id long"

    def step(state: tuple, at: int, number: int) -> tuple[tuple, None]:
        return (at, number), None

    def due(state: tuple) -> int | None:
        return None if state[1] < 0 else state[0] + GAP + 1

    def lapse(state: tuple) -> tuple[tuple, tuple]:
        return (state[0], -1), (state[1],)

    return timed(stream, "user_id", {"at": F.unix_micros("ts"), "id": F.col("event_id")}, TimedFold("at long, id long", "at long, id long", rows, (0, -1), step, due, lapse), rows, delay)


def accepted(stream: DataFrame, key: str, gap: int, delay: str) -> DataFrame:
    """(key, last, accepted): how many events of each key came ``gap`` seconds or more after the last accepted one, in the
    order of their times.

    Events wait in the state until the watermark has passed them, then no earlier one can come; those more than ``delay``
    behind the newest are late and dropped by Spark. A row tells what the waiting ones would add so far. Keys share groups as in ``TimedFold``.
    """
    step = suppression(gap)

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting, arrived = {}, {}, set()
        if state.exists:
            keys, lasts, counts, owners, times = state.get
            held = {of: (last, n) for of, last, n in zip(keys, lasts, counts, strict=True)}
            for of, s in zip(owners, times, strict=True):
                waiting.setdefault(of, set()).add(s)
        for frame in frames:
            for of, s in zip(frame[key].tolist(), frame["s"].tolist(), strict=True):
                of = None if k[0] is None else of  # noqa: PLW2901
                arrived.add(of)
                waiting.setdefault(of, set()).add(s)
        mark = state.getCurrentWatermarkMs() // 1000
        rows, rest = [], []
        for of, every in waiting.items():
            last, n = held.get(of, (-1, 0))
            past, later = sorted(s for s in every if s < mark), sorted(s for s in every if s >= mark)
            for s in past:
                last, n = step((last, n), s)
            held[of] = shown = (last, n)
            rest += [(of, s) for s in later]
            for s in later:
                shown = step(shown, s)
            if past or of in arrived:
                rows.append((of, *shown))
        state.update(([*held], [x for x, _ in held.values()], [x for _, x in held.values()], [x for x, _ in rest], [x for _, x in rest]))
        if rest:
            state.setTimeoutTimestamp(max(min(s for _, s in rest) * 1000 + 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[key, "last", "accepted"])

    rows = stream.withWatermark("ts", delay).select(_bundle(key), key, "ts", F.unix_timestamp("ts").alias("s"))
    kinds = "keys array<long>, lasts array<long>, counts array<long>, owners array<long>, times array<long>"
    return rows.groupBy("bundle").applyInPandasWithState(fold, f"{key} long, last long, accepted long", kinds, "update", GroupStateTimeout.EventTimeTimeout)


def near_in_time(stream: DataFrame, delay: str) -> DataFrame:
    """(event_id, other): each signup with the clicks of its user within an hour, either way; null where there is none and, by the
    watermarks of both sides, none can come any more. Both sides forget what nothing can be near to."""
    left = stream.where("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("at")).withWatermark("at", delay)
    right = stream.where("event_type = 'click'").select(F.col("event_id").alias("other"), F.col("user_id").alias("of"), F.col("ts").alias("other_at")).withWatermark("other_at", delay)
    near = F.expr("of = user_id and other_at >= at - interval 1 hour and other_at <= at + interval 1 hour")
    return left.join(right, near, "left_outer").select("event_id", "other")


def incremental_upsert(stream: DataFrame, key: str) -> DataFrame:
    """The newest event of each key, kept up to date batch by batch."""
    return stream.groupBy(key).agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("newest")).select(key, "newest.*")


def late_counts(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """(start, n) of buckets; events later than ``delay`` behind the newest one no longer change closed buckets."""
    # the group is the window itself: of its start alone Spark wouldn't know when it closes
    counts = stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "n")
