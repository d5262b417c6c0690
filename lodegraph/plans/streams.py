"""Streams over the events as they arrive, out of order and late, compared with SQL that knows which rows come too late."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as R
from .catalog import query

#: Each event with the part it arrives in and ``mark``: the watermark, a day behind the newest event of the parts before.
_PARTS = "e AS (SELECT *, CAST(least(3, (day(ts) - 1) // 8 + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END) AS INT) AS part FROM events)"
_ARRIVED = f"""{_PARTS},
m AS (SELECT part, max(ts) AS newest FROM e GROUP BY part),
a AS (SELECT e.*, (SELECT date_trunc('millisecond', max(newest)) - INTERVAL 1 DAY FROM m WHERE m.part < e.part) AS mark FROM e)"""
_DELAY = "1 day"


def _late_counts(unit: str) -> str:
    return f"WITH {_ARRIVED}, b AS (SELECT time_bucket(INTERVAL 1 {unit}, ts) AS start, mark FROM a) SELECT start, count(*) AS n FROM b WHERE mark IS NULL OR start + INTERVAL 1 {unit} > mark GROUP BY 1"


def _counts(t, width: str):
    log = R.Arrivals(t)
    counts = R.drained(log, R.late_counts(log.stream, width, _DELAY), ["start"])
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("v01_stream_timeline", _late_counts("HOUR"))
def v01s(t):
    return _counts(t, "1 hour")


@query("v05_stream_suppression", f"""WITH RECURSIVE {_ARRIVED}, k AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM a WHERE mark IS NULL OR ts > mark),
f AS (SELECT user_id, rn, s AS last, 1 AS n FROM k WHERE rn = 1 UNION ALL SELECT k.user_id, k.rn, CASE WHEN k.s - last >= 86400 THEN k.s ELSE last END, CASE WHEN k.s - last >= 86400 THEN n + 1 ELSE n END FROM f JOIN k ON k.user_id = f.user_id AND k.rn = f.rn + 1)
SELECT user_id, CAST(arg_max(n, rn) AS BIGINT) AS accepted FROM f GROUP BY user_id""")
def v05s(t):
    log = R.Arrivals(t)
    return R.drained(log, R.accepted(log.stream, "user_id", 86400, _DELAY), ["user_id"]).select("user_id", "accepted")


@query("v07_incremental_sync", "SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type FROM events GROUP BY user_id")
def v07s(t):
    log = R.Arrivals(t)
    return R.drained(log, R.incremental_upsert(log.stream, "user_id"), ["user_id"])


@query("v08_polling_cursor", f"WITH {_ARRIVED}, p AS (SELECT *, row_number() OVER (ORDER BY part, event_id NULLS FIRST, event_type NULLS FIRST) - 1 AS seq FROM a) SELECT event_type, max(seq) AS cursor, max(event_id) AS newest, count(*) AS handled FROM p GROUP BY event_type")
def v08s(t):
    return R.polled(R.Arrivals(t), "event_type", "event_id")


#: Events that aren't late, in order, and ``last``: the watermark when all parts have come, up to which the timers act.
_TIMELY = f"{_ARRIVED}, w AS (SELECT epoch_us(date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY) AS last FROM events), k AS (SELECT *, epoch_us(ts) AS s FROM a, w WHERE mark IS NULL OR ts > mark)"


@query("v04_stream_debounce", f"WITH {_TIMELY}, n AS (SELECT user_id, event_id, s, last, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS following FROM k WHERE s < last) SELECT user_id, event_id FROM n WHERE s + 60000001 <= last AND (following IS NULL OR following - s > 60000000)")
def v04s(t):
    """The last event of each run, told by a timer once the user was quiet for a minute."""
    log = R.Arrivals(t)
    with R.state_in_rocksdb(t.spark):
        return R.drained(log, R.debounced(log.stream, _DELAY), ["user_id", "event_id"])


@query("v09_stream_leases", f"""WITH RECURSIVE {_TIMELY}, q AS (SELECT user_id, event_type AS k, s, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS rn FROM k WHERE s < last),
f AS (SELECT user_id, 0::BIGINT AS rn, 'queued' AS status, -1::BIGINT AS holder, 0::BIGINT AS until, 0 AS attempts, 0 AS expired, 0 AS refused FROM (SELECT DISTINCT user_id FROM k)
UNION ALL SELECT user_id, rn2,
 CASE WHEN k = 'signup' AND status IN ('succeeded', 'failed') THEN 'queued' WHEN k = 'click' AND may THEN 'running' WHEN k = 'purchase' AND held THEN 'succeeded' WHEN k = 'error' AND held THEN CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END ELSE status END,
 CASE WHEN k = 'signup' AND status IN ('succeeded', 'failed') OR k IN ('purchase', 'error') AND held THEN -1 WHEN k = 'click' AND may THEN id % 3 ELSE holder END,
 CASE WHEN k = 'signup' AND status IN ('succeeded', 'failed') OR k = 'purchase' AND held THEN s WHEN k = 'click' AND may OR k = 'view' AND held THEN s + 43200000000 WHEN k = 'error' AND held THEN CASE WHEN attempts < 3 THEN s + 10800000000 ELSE s END ELSE until END,
 CASE WHEN k = 'signup' AND status IN ('succeeded', 'failed') THEN 0 WHEN k = 'click' AND may THEN attempts + 1 ELSE attempts END, expired,
 CASE WHEN k IN ('view', 'purchase', 'error') AND NOT held THEN refused + 1 ELSE refused END
 FROM (SELECT *, status = 'queued' AND until <= s AS may, status = 'running' AND holder = id % 3 AS held
  FROM (SELECT f.user_id, e.rn AS rn2, k, s, id, attempts, refused, until, expired + CAST(ended AS INT) AS expired, CASE WHEN ended THEN 'queued' ELSE status END AS status, CASE WHEN ended THEN -1 ELSE holder END AS holder
   FROM (SELECT f.*, e.rn AS at_rn, status = 'running' AND until <= e.s AS ended FROM f JOIN q e ON e.user_id = f.user_id AND e.rn = f.rn + 1) f JOIN q e ON e.user_id = f.user_id AND e.rn = f.at_rn)))
SELECT user_id, CASE WHEN ended THEN 'queued' ELSE status END AS status, attempts::BIGINT AS attempts, (expired + CAST(ended AS INT))::BIGINT AS expired, refused::BIGINT AS refused
FROM (SELECT f.*, status = 'running' AND until <= last AS ended FROM f, w) JOIN (SELECT user_id, max(rn) AS rn FROM f GROUP BY user_id) USING (user_id, rn)""")
def v09s(t):
    """The work queue as a stream: a lease that ends is acted on by a timer, whether an event of its job follows or not."""
    log = R.Arrivals(t)
    with R.state_in_rocksdb(t.spark):
        return R.drained(log, R.leases(log.stream, _DELAY), ["user_id"])


#: The same where two sides are joined: the watermark follows the side that is behind.
_BOTH = f"""{_PARTS}, m AS (SELECT part, max(ts) FILTER (WHERE event_type = 'signup') AS l, max(ts) FILTER (WHERE event_type = 'click') AS r FROM e GROUP BY part),
a AS (SELECT e.*, (SELECT date_trunc('millisecond', least(max(l), max(r))) - INTERVAL 1 DAY FROM m WHERE m.part < e.part) AS mark FROM e),
w AS (SELECT epoch_us(date_trunc('millisecond', least(max(l), max(r))) - INTERVAL 1 DAY) AS last FROM m), k AS (SELECT *, epoch_us(ts) AS s FROM a, w WHERE mark IS NULL OR ts > mark)"""


@query("v10_stream_retries", f"""WITH RECURSIVE {_TIMELY}, q AS (SELECT user_id, event_type AS k, s, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS rn FROM k WHERE s < last),
f AS (SELECT user_id, 0::BIGINT AS rn, 'scheduled' AS outcome, 0 AS attempts, 0::BIGINT AS next_at, 0 AS early, 0 AS told, 0 AS due FROM (SELECT DISTINCT user_id FROM k)
UNION ALL SELECT user_id, rn2,
 CASE WHEN k = 'signup' AND NOT waits THEN 'scheduled' WHEN tries AND k = 'click' THEN 'delivered' WHEN tries THEN CASE WHEN attempts + 1 < 3 THEN 'retry' ELSE 'dead_letter' END ELSE outcome END,
 CASE WHEN k = 'signup' AND NOT waits THEN 0 WHEN tries THEN attempts + 1 ELSE attempts END,
 CASE WHEN k = 'signup' AND NOT waits OR tries AND (k = 'click' OR attempts + 1 >= 3) THEN s WHEN tries THEN s + (attempts + 1) * 10800000000 ELSE next_at END,
 CASE WHEN k IN ('click', 'error') AND waits AND s < next_at THEN early + 1 ELSE early END,
 CASE WHEN k = 'signup' AND NOT waits OR tries THEN 0 ELSE told END, due
 FROM (SELECT *, outcome IN ('scheduled', 'retry') AS waits, outcome IN ('scheduled', 'retry') AND k IN ('click', 'error') AND s >= next_at AS tries
  FROM (SELECT f.user_id, q.rn AS rn2, q.k, q.s, outcome, attempts, next_at, early, CASE WHEN outcome IN ('scheduled', 'retry') AND told = 0 AND next_at <= q.s THEN 1 ELSE told END AS told,
   due + CAST(outcome IN ('scheduled', 'retry') AND told = 0 AND next_at <= q.s AS INT) AS due FROM f JOIN q ON q.user_id = f.user_id AND q.rn = f.rn + 1)))
SELECT user_id, outcome, attempts::BIGINT AS attempts, next_at, early::BIGINT AS early, (due + CAST(outcome IN ('scheduled', 'retry') AND told = 0 AND next_at <= last AS INT))::BIGINT AS due
FROM f JOIN (SELECT user_id, max(rn) AS rn FROM f GROUP BY user_id) USING (user_id, rn), w""")
def v10s(t):
    """Deliveries and their retries as a stream: when a retry's time has come a timer tells it."""
    log = R.Arrivals(t)
    with R.state_in_rocksdb(t.spark):
        return R.drained(log, R.retries(log.stream, _DELAY), ["user_id"])


@query("j11_stream_proximity", f"WITH {_BOTH} SELECT a.event_id, CASE WHEN count(b.event_id) > 0 THEN '' ELSE '*' END AS marker FROM k a LEFT JOIN k b ON b.user_id = a.user_id AND b.event_type = 'click' AND abs(a.s - b.s) <= 3600000000 WHERE a.event_type = 'signup' GROUP BY a.event_id, a.s, a.last HAVING count(b.event_id) > 0 OR a.s + 3600000000 < a.last")
def j11s(t):
    """A start of a session with what the same user loaded within an hour; one that nothing came near to is marked, once nothing can."""
    log = R.Arrivals(t)
    return R.drained(log, R.near_in_time(log.stream, _DELAY), ["event_id"], "append").select("event_id", F.when(F.col("other").isNull(), "*").otherwise("").alias("marker"))


@query("v17_watermarked_counts", _late_counts("DAY"))
def v17s(t):
    return _counts(t, "1 day")
