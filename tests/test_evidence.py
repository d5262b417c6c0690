"""Evidence by content: what changes a root, and what a diff finds."""

import random

import pytest

from lodegraph.operators import evidence as E
from lodegraph.sources.scratch import stored

ROW = "g string, k long, v string, n int"


def trees(spark, *tables):
    return [stored(E.tree(spark.createDataFrame(t, ROW).repartition(3), ["g"], "k", ["k", "v", "n"])) for t in tables]


def some_rows(seed):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.randrange(200_000), rng.choice(["x", "", None, "é"]), rng.choice([None, 1, 2])) for _ in range(400)]


def root(nodes, group="a"):
    return {r.g: r.digest for r in E.roots(nodes, ["g"]).collect()}[group]


@pytest.mark.parametrize("change", [lambda r: (r[0], r[1], "other", r[3]), lambda r: (r[0], r[1], r[2], 77), lambda r: (r[0], r[1] + 1, r[2], r[3])])
def test_one_changed_value_changes_the_root_and_is_found(spark, change):
    rows = some_rows(1)
    i = next(i for i, r in enumerate(rows) if r[0] == "a")
    old, same, new = trees(spark, rows, rows[::-1], [*rows[:i], change(rows[i]), *rows[i + 1 :]])
    assert root(old) == root(same) != root(new)
    assert root(old, "b") == root(new, "b")
    assert E.differing(old, same, ["g"]).count() == 0
    found = E.differing(old, new, ["g"]).collect()
    assert {(r.g, r["first"]) for r in found} == {("a", k // E.WIDTH * E.WIDTH) for k in (rows[i][1], change(rows[i])[1])}


def test_repeats_count_and_nulls_are_not_empty(spark):
    one, two, null, empty = trees(spark, [("a", 1, "x", 1)], [("a", 1, "x", 1)] * 2, [("a", 1, None, 1)], [("a", 1, "", 1)])
    assert len({root(t) for t in (one, two, null, empty)}) == 4


def test_diff_against_a_plain_one(spark):
    old = some_rows(2)
    new = [r for i, r in enumerate(old) if i % 50] + [("a", 3_000_000, "new", 1), ("c", 5, "group", 1)]
    ranges = lambda rows: {(g, k // E.WIDTH): sorted((r for r in rows if r[0] == g and r[1] // E.WIDTH == k // E.WIDTH), key=repr) for g, k, *_ in rows}
    a, b = ranges(old), ranges(new)
    want = sorted((g, k * E.WIDTH, len(a.get((g, k), [])), len(b.get((g, k), []))) for g, k in a.keys() | b.keys() if a.get((g, k)) != b.get((g, k)))
    got = E.differing(*trees(spark, old, new), ["g"]).collect()
    assert sorted((r.g, r["first"], r.old_rows, r.new_rows) for r in got) == want


def test_levels_follow_the_keys(spark):
    (far,) = trees(spark, [("a", 10**12, "x", 1), ("a", 5, "x", 1)])
    tops = far.where("g = 'a'").orderBy("level").groupBy("level").count().orderBy("level").collect()
    assert tops[-1]["count"] == 1 and tops[0]["count"] == 2


@pytest.mark.parametrize("whole", [0, 150, 1000])
def test_roots_alone_are_those_of_the_tree(spark, whole):
    """Built in the groups or, for large ones, level by level; a small group's rows move once and no level is written."""
    rows = spark.createDataFrame([*some_rows(3), ("c", 10**9, "x", 1), (None, 5, "x", 1)], ROW).repartition(3)
    want = {r.g: (r.rows, r.digest) for r in E.roots(E.tree(rows, ["g"], "k", ["k", "v", "n"]), ["g"]).collect()}
    got = E.roots_of(rows, ["g"], "k", ["k", "v", "n"], whole=whole)
    assert {r.g: (r.rows, r.digest) for r in got.collect()} == want
    if whole == 1000:
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
