"""Strongly connected components, shortest paths and suppression against plain versions."""

import random

import pytest

from conftest import SMALL
from lodegraph.operators import structure as R
from lodegraph.plans import QUERIES

EDGE = "src string, dst string"


def plain_components(edges):
    """Tarjan's, without recursion."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())

    def reached(a):
        seen, todo = set(), [a]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    far = {a: reached(a) for a in out}
    found = {}
    for a in out:
        group = {b for b in far[a] if a in far[b]} | {a}
        if len(group) > 1:
            found[a] = min(group)
    return found


@pytest.mark.parametrize(("seed", "nodes", "n"), [(1, 12, 20), (2, 30, 34)])
def test_components_against_plain_ones(spark, monkeypatch, seed, nodes, n):
    monkeypatch.setattr(R, "LOCAL_EDGES", 0)
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(n)]
    # two rings joined by long chains, one of which leads back, and tails
    edges += [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("r1", "a0"), *((f"a{i}", f"a{i + 1}") for i in range(6)), ("a6", "q0"), ("q0", "q1"), ("q1", "q0"), ("q1", "t0"), ("t0", "t1"), ("t1", "t2")]
    edges += [("q0", "b0"), ("b0", "b1"), ("b1", "r2")] if seed % 2 else [("r2", "z0"), ("z0", "z1"), ("z1", "r2"), ("x", "x")]
    got = R.strongly_connected(spark.createDataFrame(edges, EDGE).repartition(3))
    assert {r.node: r.component for r in got.collect()} == plain_components(edges)
    assert got.count() == len(plain_components(edges))
    monkeypatch.setattr(R, "LOCAL_EDGES", 10_000)  # by one task
    assert {r.node: r.component for r in R.strongly_connected(spark.createDataFrame(edges, EDGE)).collect()} == plain_components(edges)


def test_a_long_ring_and_a_long_tail(spark, monkeypatch):
    monkeypatch.setattr(R, "LOCAL_EDGES", 0)
    ring = [(f"n{i:04d}", f"n{(i + 1) % 1000:04d}") for i in range(1000)] + [("n0500", "t0")] + [(f"t{i}", f"t{i + 1}") for i in range(300)]
    got = R.strongly_connected(spark.createDataFrame(ring, EDGE)).groupBy("component").count().collect()
    assert [tuple(r) for r in got] == [("n0000", 1000)]
    assert R.strongly_connected(spark.createDataFrame([], EDGE)).count() == 0
    monkeypatch.setattr(R, "LOCAL_EDGES", 10_000)
    assert [tuple(r) for r in R.strongly_connected(spark.createDataFrame(ring, EDGE)).groupBy("component").count().collect()] == [("n0000", 1000)]


def plain_paths(edges, pairs, most):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = []
    for a, b in set(pairs):
        ways = [[a]]
        seen = {a}
        for _ in range(most + 1):
            done = [w for w in ways if w[-1] == b]
            if done:
                found.append((a, b, len(min(done)) - 1, min(done)))
                break
            ways = [w + [y] for w in ways for y in out.get(w[-1], ()) if y not in seen]
            seen |= {w[-1] for w in ways}
            best = {}
            for w in ways:
                best[w[-1]] = min(best.get(w[-1], w), w)
            ways = list(best.values())
    return sorted(found)


@pytest.mark.parametrize(("seed", "most"), [(1, 9), (2, 3), (3, 9)])
def test_paths_against_plain_ones(spark, seed, most):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(70)]
    pairs = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(42):02d}") for _ in range(60)] + [("n01", "n01"), ("n01", "n01")]
    got = R.shortest_paths(spark.createDataFrame(edges, EDGE), spark.createDataFrame(pairs, "start string, goal string"), most)
    assert sorted((r.start, r.goal, r.length, r.path) for r in got.collect()) == plain_paths(edges, pairs, most)


def test_a_hub_between_both_ends(spark):
    """From both ends only the ends' few neighbours are met before the hub's many."""
    edges = [("a", "b"), ("b", "hub"), ("hub", "c"), ("c", "d")] + [("hub", f"x{i}") for i in range(500)] + [(f"y{i}", "hub") for i in range(500)]
    got = R.shortest_paths(spark.createDataFrame(edges, EDGE), spark.createDataFrame([("a", "d")], "start string, goal string"), 8).collect()
    assert [r.path for r in got] == [["a", "b", "hub", "c", "d"]]


def test_pairs_share_the_search_of_an_end(spark, monkeypatch):
    """Many goals of one start, in a part that it can't leave: what is kept grows with the part, not with the pairs."""
    kept, store = [], R.stored

    def counting(df):
        found = store(df)
        if "near" in df.columns and "depth" in df.columns:
            kept.append(found.count())
        return found

    monkeypatch.setattr(R, "stored", counting)
    chain = [(f"a{i}", f"a{i + 1}") for i in range(6)]
    pairs = [("a0", f"z{i}") for i in range(50)] + [("a0", "a6"), ("a1", "a6")]
    got = R.shortest_paths(spark.createDataFrame(chain, EDGE), spark.createDataFrame(pairs, "start string, goal string"), 10).collect()
    assert sorted((r.start, r.length) for r in got) == [("a0", 6), ("a1", 5)]
    assert sum(kept) <= 2 * len(chain)


def test_open_pairs_do_not_meet_the_whole_front(spark, monkeypatch):
    """400 starts of one goal that none reaches: a join made a row for each pair and node of the goal's front."""
    made, store = [], R.stored

    def rows(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return rows(plan.executedPlan())
        if "QueryStage" in name:
            return rows(plan.plan())
        if "Join" in name:
            made.append(plan.metrics().apply("numOutputRows").value())
        for i in range(plan.children().size()):
            rows(plan.children().apply(i))

    def watched(df):
        df.collect()
        rows(df._jdf.queryExecution().executedPlan())
        return store(df)

    monkeypatch.setattr(R, "stored", watched)
    edges = [("goal", "hub")] + [("hub", f"x{i}") for i in range(300)]
    ways = edges + [(b, a) for a, b in edges]
    pairs = [(f"s{i}", "goal") for i in range(400)] + [("x7", "goal")]
    got = R.shortest_paths(spark.createDataFrame(ways, EDGE), spark.createDataFrame(pairs, "start string, goal string"), 4).collect()
    assert [r.path for r in got] == [["x7", "hub", "goal"]]
    assert max(made) <= 1000


def accepted(times, gap):
    last, n = None, 0
    for t in sorted(times):
        if last is None or t - last >= gap:
            last, n = t, n + 1
    return n


@pytest.mark.parametrize("seed", range(3))
def test_suppression_counts_like_the_sequence(spark, seed):
    rng = random.Random(seed)
    logs = {k: [rng.randrange(-500, 40 * 10**k) for _ in range(rng.randint(1, 300))] for k in range(4)} | {7: [0], 8: [0, 100, 299, 300, 500, 650], 9: [5] * 40}
    rows = [(k, t) for k, ts in logs.items() for t in ts] + [(7, None)]
    got = R.steps_from_first(spark.createDataFrame(rows, "k int, t long"), "k", "t", 300)
    assert {r.k: r.accepted for r in got.collect()} == {k: accepted(ts, 300) for k, ts in logs.items()}


def test_suppression_has_no_task_for_each_user(spark):
    plan = QUERIES["v05_repeat_suppression"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_a_busy_user(spark):
    rows = spark.range(2_000_000).selectExpr("1 as k", "id as t")
    assert [r.accepted for r in R.steps_from_first(rows, "k", "t", 86400).collect()] == [24]
