"""Versioned tables, job queues and other state as folds over logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key: the newest of both tables, the new one's on a tie. Aggregates before the shuffle."""
    columns = [c for c in old.columns if c not in keys]
    both = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    newest = F.max_by(F.struct(*columns), F.struct(version, "__side")).alias("row")
    return both.groupBy(*keys).agg(newest).select(*keys, "row.*")


def revisions(log: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The log with ``revision`` 1, 2, ... of each key."""
    return log.withColumn("revision", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def versioned(writes: DataFrame, held: str, base: str, force: str) -> DataFrame:
    """``writes`` with ``outcome`` and ``version``: what an optimistic version check makes of each; ``held`` is null for new keys."""
    stored = F.coalesce(held, F.lit(0))
    outcome = F.when(F.col(held).isNull() & (F.col(base) == 0), "created").when(F.col(held) == F.col(base), "updated").when(F.col(force), "forced").otherwise("conflict")
    return writes.withColumn("outcome", outcome).withColumn("version", F.when((stored == F.col(base)) | F.col(force), stored + 1).otherwise(F.col(held)))


def ordered_fold(
    rows: DataFrame, key: str, order: Sequence[str], start: tuple, step: Callable[..., tuple], result: str, each: Callable[..., tuple | None] | None = None
) -> DataFrame:
    """(key, *state) after each key's rows in order; ``result`` names and types the columns of the state.

    Spark deals and sorts the rows; they pass a task one by one and only the state of the key at hand is held, so a key
    may have any number of rows. ``step(state, *values)`` takes the columns that aren't the key. With ``each(before,
    after, *values)`` the rows are what it makes of each row, None being none, instead of the last state.
    """
    values = [c for c in rows.columns if c != key]
    kind = rows.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in result.split(", "))]
    ready = rows.repartition(key).sortWithinPartitions(key, *order).select(key, *values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kinds = None, None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, *([None] * (len(names) - 1))]
            done = []
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or k != now:
                    if state is not None and each is None:
                        done.append((now, *state))
                    now, state = k, start
                before, state = state, step(state, *row)
                if each and (found := each(before, state, *row)) is not None:
                    done.append((k, *found))
            if done:
                yield out(done)
        if state is not None and each is None:
            yield out([(now, *state)])

    return ready.mapInArrow(run, f"{key} {kind}, {result}")


def numbered(rows: DataFrame, key: str, run: int = 4096) -> DataFrame:
    """``rows`` with ``number``, 0, 1, ... by an integer key: runs of keys are counted, their starts summed, and each run
    is numbered on its own, so the one task that sees all runs has a row for each ``run`` keys."""
    cut = rows.withColumn("__run", F.floor(F.col(key) / run))
    before = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("__run").agg(F.count("*").alias("__n")).select("__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__run").orderBy(key)) - 1
    return cut.withColumn("__place", place).join(starts, "__run").withColumn("number", F.col("__start") + F.col("__place")).drop("__run", "__place", "__start")


def budget_prefix(rows: DataFrame, by: str, cost: str, budget: int, *order: Column | str) -> DataFrame:
    """Rows whose running cost within the group stays within the budget."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def suppression(gap: int) -> Callable[..., tuple]:
    """Step of (last, accepted): a time is accepted if none was or it is ``gap`` or more after the last accepted."""
    return lambda state, at: (at, state[1] + 1) if not state[1] or at - state[0] >= gap else state


def greedy(budget: int) -> Callable[..., tuple]:
    """Step of (used, fitted): a cost that doesn't fit any more is skipped."""
    return lambda state, _, cost: (state[0] + cost, state[1] + 1) if state[0] + cost <= budget else state


def downgrading(least: int) -> Callable[..., tuple]:
    """Step of (left,): an item costs what it asks for, ``least`` where only that is left, nothing where not even that is."""
    return lambda state, *row: (state[0] - (row[-1] if state[0] >= row[-1] else least if state[0] >= least else 0),)


def granted(least: int) -> Callable[..., tuple | None]:
    """(node, level) of an item that ``downgrading`` has let in: its own level, or 1."""
    return lambda before, after, _, node, level, cost: (node, level) if before[0] >= cost else (node, 1) if before[0] >= least else None


#: Of the work queue and the retries: lease and delay in microseconds, attempts.
LEASE, DELAY, MOST_ATTEMPTS = 12 * 3600 * 1_000_000, 3 * 3600 * 1_000_000, 3


def queue_step(state: tuple, at: int, _: int, action: str, worker: int) -> tuple:
    """A job of a work queue: (status, holder, until, attempts, expired, refused); ``until`` is when a queued job becomes
    due or a running one's lease ends.

    A worker claims a due job or one whose lease has ended; a heartbeat extends the lease, a completion or failure ends
    it, each only by the worker who holds it. A failed job is queued again after a delay while it has attempts left.
    """
    status, holder, until, attempts, expired, refused = state
    held = status == "running" and holder == worker
    if action == "enqueue":
        return ("queued", -1, at, 0, expired, refused) if status in ("succeeded", "failed") else state
    if action == "claim":
        if status not in ("queued", "running") or until > at:
            return state
        return ("running", worker, at + LEASE, attempts + 1, expired + (status == "running"), refused)
    if not held:
        return (*state[:5], refused + 1)
    if action == "heartbeat":
        return (status, holder, at + LEASE, attempts, expired, refused)
    if action == "complete":
        return ("succeeded", -1, at, attempts, expired, refused)
    return ("queued", -1, at + DELAY, attempts, expired, refused) if attempts < MOST_ATTEMPTS else ("failed", -1, at, attempts, expired, refused)


def retry_step(state: tuple, at: int, _: int, action: str) -> tuple:
    """A delivery: (outcome, attempts, next_at, early). An attempt before its time doesn't count; a failed one is retried
    after a delay that grows with the attempts, the last one goes to the dead letters."""
    outcome, attempts, next_at, early = state
    waits = outcome in ("scheduled", "retry")
    if action == "schedule":
        return state if waits else ("scheduled", 0, at, early)
    if not waits:
        return state
    if at < next_at:
        return (outcome, attempts, next_at, early + 1)
    if action == "deliver":
        return ("delivered", attempts + 1, at, early)
    return ("retry", attempts + 1, at + (attempts + 1) * DELAY, early) if attempts + 1 < MOST_ATTEMPTS else ("dead_letter", attempts + 1, at, early)


#: States of a reminder that still waits for its delivery.
WAITING = ("scheduled", "snoozed", "rescheduled", "retry_scheduled")


def reminder_step(state: tuple, at: int, _: int, action: str, retries: bool) -> tuple:
    """A reminder: (state, attempts, errors); a transition that its state doesn't allow is an error and changes nothing."""
    now, attempts, errors = state
    if action == "schedule" and now not in WAITING:
        return ("scheduled", 0, errors)
    if action in ("snooze", "reschedule") and now not in ("none", "canceled", "delivered"):
        return ("snoozed" if action == "snooze" else "rescheduled", attempts, errors)
    if now in WAITING:
        if action == "cancel":
            return ("canceled", attempts, errors)
        if action == "deliver":
            return ("delivered", attempts + 1, errors)
        if action == "fail":
            left = "failed" if not retries else "retry_scheduled" if attempts + 1 < MOST_ATTEMPTS else "dead_letter"
            return (left, attempts + 1, errors)
    return (now, attempts, errors + 1)
