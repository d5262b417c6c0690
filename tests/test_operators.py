"""Formulas and folds on small hand-checked cases."""

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import text as X
from lodegraph.operators import analytics as A
from lodegraph.operators import graph as G
from lodegraph.operators import learning as L
from lodegraph.operators import search as S
from lodegraph.operators import state as Z


def one(df):
    return df.first()[0]


@pytest.mark.parametrize(("log", "want"), [([True, True, False], 1.3), ([True] * 5 + [False], 1.9), ([False] * 20, 0.1), ([], 1.0)])
def test_clamped_weight(spark, log, want):
    df = spark.createDataFrame([(log,)], "log array<boolean>")
    assert one(df.select(L.clamped_weight(F.col("log")))) == pytest.approx(want)


@pytest.mark.parametrize("seed", range(4))
def test_folded_weights_equal_the_sequence(spark, seed):
    import random

    random.seed(seed)
    rows = [(k, f"2024-01-{1 + i // 7:02d} 00:00:{i % 60:02d}", i, random.random() < 0.5 + 0.1 * seed) for k in range(3) for i in range(60)]
    log = spark.createDataFrame(rows, "k int, ts string, i int, good boolean").withColumn("ts", F.to_timestamp("ts"))
    got = {r["k"]: r["weight"] for r in L.folded_weights(log, "k", ["ts", "i"], F.col("good")).collect()}
    for k in range(3):
        w = 1.0
        for _, _, _, good in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            w = min(w + 0.2, 2.0) if good else max(w - 0.1, 0.1)
        assert got[k] == pytest.approx(w)


def test_dual_score(spark):
    assert one(spark.range(1).select(L.dual_score(F.lit(3), F.lit(2)))) == pytest.approx(1 / 3)


def test_entropy_and_bias(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "t string, n long")
    assert one(A.entropy(counts)) == pytest.approx(0.946394, abs=1e-5)
    assert one(A.entropy(counts.where("t = 'a'"))) == 0.0
    assert {r["t"]: r["bias"] for r in A.type_bias(counts).collect()} == {"a": 0.25, "b": 0.25, "c": 0.5}


def test_fusion(spark):
    a = spark.createDataFrame([("x", 1, 100)], "name string, rank int, score int")
    b = spark.createDataFrame([("x", 1, 1), ("y", 2, 1)], "name string, rank int, score int")
    got = {r["name"]: r["rrf"] for r in S.fuse(a, b, 0.5).collect()}
    assert got == {"x": pytest.approx(0.0826), "y": pytest.approx(0.0227)}


def test_boost(spark):
    assert one(spark.range(1).select(S.boost(F.lit(0.05), F.lit("p"), "p", F.lit(True)))) == pytest.approx(0.0225)


def test_impact_risk(spark):
    score, band = G.impact_risk(F.lit(3), F.lit(4), F.lit(2), F.lit(1))
    assert tuple(spark.range(1).select(score, band).first()) == (93, "CRITICAL")


def test_paths_use_no_edge_twice(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "id string")
    chains = {">".join(r["chain"]) for r in G.paths(edges, starts, 4).collect()}
    assert chains == {"a>b", "a>b>a", "a>b>c"}


def test_reach_is_least_distance(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "id string")
    assert {(r["node"], r["distance"]) for r in G.reach(edges, starts, 3).collect()} == {("b", 1), ("c", 1), ("d", 2)}


def test_upsert_prefers_new(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "k int, v string, version int")
    assert sorted(tuple(r) for r in Z.upsert(old, new, ["k"], "version").select("k", "v").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_keywords_fall_back_to_the_text(spark):
    df = spark.createDataFrame([("find the user_login of x",), ("the of",)], "t string")
    assert [r[0] for r in df.select(X.keywords(F.col("t"))).collect()] == [["find", "user_login"], ["the of"]]


def test_match_tier(spark):
    df = spark.createDataFrame([("Login",), ("login_user",), ("do_login",), ("other",), (None,)], "n string")
    assert [r[0] for r in df.select(X.match_tier(F.col("n"), "login")).collect()] == [100, 80, 60, 40, 40]


def test_folds_hold_one_state(spark):
    """Keys spread over partitions and batches, null keys too; the last state of each, or what each row gives."""
    rows = [(k, i, (i * 37 + (k or 0)) % 90) for k in (None, *range(20)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, c int").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {r["k"]: (r["used"], r["n"]) for r in Z.ordered_fold(df, "k", ["i"], (0, 0), Z.greedy(300), "used long, n long").collect()}
        each = Z.ordered_fold(df, "k", ["i"], (0, 0), Z.greedy(300), "i long", lambda a, b, i, _: (i,) if a != b else None).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, taken = {}, set()
    for k, i, c in rows:
        used, n = want.get(k, (0, 0))
        if used + c <= 300:
            want[k] = (used + c, n + 1)
            taken.add((k, i))
    assert got == want and {(r["k"], r["i"]) for r in each} == taken
    assert Z.ordered_fold(df.limit(0), "k", ["i"], (0, 0), Z.greedy(300), "used long, n long").collect() == []


def test_numbers_follow_the_key(spark):
    keys = sorted({(i * i * 31) % 20_000 for i in range(3000)})
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    assert {r["k"]: r["number"] for r in Z.numbered(df, "k", run=100).collect()} == {k: i for i, k in enumerate(keys)}


def test_chains_are_shortest_ways(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "id string")
    got = {r["node"]: ">".join(r["chain"]) for r in G.reach(edges, starts, 3, chains=True).collect()}
    assert got == {"b": "a>b", "c": "a>c", "d": "a>b>d", "e": "a>b>d>e"}


def test_queue_leases():
    """A claim before the lease's end is refused, after it taken over; the first worker's completion is then refused."""
    state, hour = ("queued", -1, 0, 0, 0, 0), 3600 * 1_000_000
    for at, action, worker in ((0, "claim", 1), (1, "claim", 2), (13, "claim", 2), (14, "complete", 1), (20, "heartbeat", 2), (30, "fail", 2), (31, "claim", 1), (34, "claim", 1), (35, "fail", 1)):
        state = Z.queue_step(state, at * hour, 0, action, worker)
    assert state == ("failed", -1, 35 * hour, 3, 1, 1)


def test_reminders_guard_their_states():
    state = ("none", 0, 0)
    for action in ("deliver", "schedule", "snooze", "fail", "fail", "reschedule", "deliver", "cancel", "snooze"):
        state = Z.reminder_step(state, 0, 0, action, True)
    assert state == ("delivered", 3, 3)


def test_arrivals_come_late_and_in_disorder(spark):
    from conftest import SMALL
    from lodegraph.sources.bindings import Tables
    from lodegraph.streaming import streams as R

    events = Tables(spark, SMALL).events.select("ts", "event_id", R.arrival().alias("part"))
    parts = {r["part"]: r["n"] for r in events.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert set(parts) == set(range(R.ARRIVALS))
    late = events.where("event_id % 10 = 0 and dayofmonth(ts) <= 16").select(F.min(F.col("part") - F.floor((F.dayofmonth("ts") - 1) / 8))).first()[0]
    assert late == 2
