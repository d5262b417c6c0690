"""Strongly connected components and shortest paths of directed graphs of any depth, level by level over written tables.

No step collects a neighbour list or a walk: rows are edges, or (node, label), or (pair, node).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Edges, counted first, that one task can hold and settle; more are coloured by all tasks, with the same result.
LOCAL_EDGES = 200_000


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges of nodes that nothing reaches or that reach nothing: those are components of their own."""
    left = edges.count()
    while left:
        heads, tails = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
        edges = stored(edges.join(heads, "dst", "left_semi").join(tails, "src", "left_semi").select("src", "dst"))
        now = edges.count()
        if left - now < 1 + left // 10:  # what is left to trim goes with the colours
            break
        left = now
    return edges


def _jumped(chain: DataFrame, way: str) -> DataFrame:
    """(node, end, least, open) of nodes in chains, ``way`` naming the neighbour: the first node beyond the chain, and the least on
    the way to it, by pointer doubling. ``open`` stays true where there is no end, as the chain is a ring."""
    inside = chain.select(F.col("node").alias("end"))
    now = chain.select("node", F.col(way).alias("end"), F.least("node", way).alias("least")).join(inside.withColumn("open", F.lit(True)), "end", "left")
    now = stored(now.select("node", "end", "least", F.coalesce("open", F.lit(False)).alias("open")))
    span, n = 1, chain.count()
    while span < n and not now.where("open").isEmpty():
        onward = now.select(F.col("node").alias("end"), F.col("end").alias("end2"), F.col("least").alias("least2"), F.col("open").alias("open2"))
        going = now.where("open").join(onward, "end").select("node", F.col("end2").alias("end"), F.least("least", "least2").alias("least"), F.col("open2").alias("open"))
        now = stored(now.where("not open").unionByName(going))
        span *= 2
    return now


def _without_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, (node, first, last), (node, component)): nodes with one way in and one way out are taken out of the middle of
    an edge, and whole rings of them are components. Such a node is in the component of ``first`` and ``last``, if they share one."""
    outs = edges.groupBy("src").agg(F.count("*").alias("o"), F.min("dst").alias("after")).where("o = 1")
    ins = edges.groupBy("dst").agg(F.count("*").alias("i"), F.min("src").alias("before")).where("i = 1")
    chain = stored(outs.join(ins, F.col("src") == F.col("dst")).select(F.col("src").alias("node"), "before", "after"))
    ahead, back = _jumped(chain, "after"), _jumped(chain, "before")
    rings = ahead.where("open").select("node", F.col("least").alias("component"))
    held = stored(ahead.where("not open").select("node", F.col("end").alias("last")).join(back.where("not open").select("node", F.col("end").alias("first")), "node").select("node", "first", "last"))
    gone = chain.select("node")
    kept = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    # of each chain one edge from its first end to its last stays
    short = held.select(F.col("first").alias("src"), F.col("last").alias("dst"))
    return stored(kept.select("src", "dst").unionByName(short).where("src <> dst").distinct()), held, stored(rings)


def _spread(labels: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, label): each node's least label among its own and those of all nodes that reach it along ``source`` -> ``target``.
    Only nodes whose label has changed speak in the next round."""
    front = labels
    while not front.isEmpty():
        heard = front.join(edges, F.col("node") == F.col(source)).groupBy(F.col(target).alias("node")).agg(F.min("label").alias("heard"))
        front = stored(heard.join(labels, "node").where("heard < label").select("node", F.col("heard").alias("label")))
        labels = stored(labels.join(front.withColumnRenamed("label", "better"), "node", "left").select("node", F.coalesce("better", "label").alias("label")))
    return labels


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges``: forward colours, then backward from each colour's root within its colour."""
    found = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while not edges.isEmpty():
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours = _spread(stored(nodes.withColumn("label", F.col("node"))), edges, "src", "dst")
        c = lambda end: colours.select(F.col("node").alias(end), F.col("label").alias(f"{end}_c"))
        same = stored(edges.join(c("src"), "src").join(c("dst"), "dst").where("src_c = dst_c").select("src", "dst", F.col("src_c").alias("colour")))
        front = hit = stored(colours.where("node = label").select("node", F.col("label").alias("component")))
        while not front.isEmpty():
            ahead = front.join(same, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), F.col("colour").alias("component")).distinct()
            front = stored(ahead.join(hit, "node", "left_anti"))
            hit = stored(hit.unionByName(front))
        found = stored(found.unionByName(hit))
        done = hit.select("node")
        edges = _trimmed(stored(same.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")))
    return found


def _settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The components of the edges of one task: depth first with a stack of its own, each node and edge once."""
    edges = pd.concat(list(frames) or [pd.DataFrame({"src": [], "dst": []})])
    after: dict = {}
    for a, b in zip(edges["src"], edges["dst"], strict=True):
        after.setdefault(a, []).append(b)
    number, low, held, waiting, found = {}, {}, set(), [], []
    for root in after:
        todo = [(root, iter(after[root]))] if root not in number else []
        if todo:
            number[root] = low[root] = len(number)
            waiting.append(root)
            held.add(root)
        while todo:
            node, ways = todo[-1]
            for other in ways:
                if other not in number:
                    number[other] = low[other] = len(number)
                    waiting.append(other)
                    held.add(other)
                    todo.append((other, iter(after.get(other, ()))))
                    break
                if other in held:
                    low[node] = min(low[node], number[other])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == number[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(waiting.pop())
                    held.difference_update(group)
                    if len(group) > 1:
                        found += [(x, node) for x in group]
    yield pd.DataFrame(found, columns=["node", "component"])


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(src, dst) -> (node, component) of all nodes on a cycle of two or more; a component is named by its least node.

    Dead ends are trimmed and chains contracted by pointer doubling first, so long rings and tails cost a logarithm of their length; what
    remains is coloured forward and backward in as many rounds as it is deep, or settled by one task where it is small.
    """
    current = stored(edges.select("src", "dst").where("src <> dst").distinct())
    removed = []
    before = current.count()
    if before > LOCAL_EDGES:
        current = _trimmed(current)
        before = current.count()
    while before > LOCAL_EDGES:
        current, held, rings = _without_chains(current)
        current = _trimmed(current)
        removed.append((held, rings))
        now = current.count()
        if before - now < 1 + before // 10:
            break
        before = now
    if current.count() <= LOCAL_EDGES:
        kind = edges.schema["src"].dataType.simpleString()
        found = stored(current.coalesce(1).mapInPandas(_settled, f"node {kind}, component {kind}"))
    else:
        found = _coloured(current)
    for held, rings in reversed(removed):  # an end of a chain may be on a ring that was found later
        ends = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))  # noqa: E731, B023
        name = lambda end: F.coalesce(F.col(f"{end}_c"), F.col(end))
        inner = held.join(ends("first"), "first", "left").join(ends("last"), "last", "left").where(name("first") == name("last"))
        named = inner.select("node", name("first").alias("component"))
        roots = inner.select(F.col("first").alias("node"), name("first").alias("component"))
        found = stored(found.unionByName(named).unionByName(roots).distinct().unionByName(rings))
    sizes = found.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    return found.join(sizes, "component").select("node", F.col("least").alias("component"))


def _meeting(pairs: DataFrame, ahead: DataFrame, back: DataFrame) -> DataFrame:
    """(start, goal, node): the nodes that the fronts (start, node) and (goal, node) of a pair's ends have in common.

    Pairs take all nodes of their start or of their goal first, or the fronts meet at their nodes and what is no pair goes; the rows
    that each would make are counted, as many pairs of a few goals with large fronts are few meetings, and a node in many fronts is many.
    """
    size = lambda rows, by, n: rows.groupBy(by).agg(F.count("*").alias(n))
    made = {
        "start": pairs.join(size(ahead, "start", "n"), "start"),
        "goal": pairs.join(size(back, "goal", "n"), "goal"),
        "node": size(ahead, "node", "a").join(size(back, "node", "b"), "node").withColumn("n", F.col("a") * F.col("b")),
    }
    rows = {first: found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for first, found in made.items()}
    first = min(rows, key=rows.get)
    if first == "start":
        return pairs.join(ahead, "start").join(back, ["goal", "node"])
    if first == "goal":
        return pairs.join(back, "goal").join(ahead, ["start", "node"])
    return ahead.join(back, "node").join(pairs, ["start", "goal"], "left_semi")


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(start, goal) -> (start, goal, length, path): for each pair that up to ``most`` edges join, the shortest path; of several the
    least in the order of its nodes.

    Searches run from both ends, the side whose front is smaller goes on, and a pair is done when they meet. A search belongs to its end
    alone, so all pairs that have this end share it, and it goes on while one of them is open. Only the edges that reach a node first are
    kept; from the meeting nodes they give the nodes of all shortest paths, of which each step takes the least.
    """
    step = stored(edges.select(F.col("src").alias("from"), F.col("dst").alias("to")).distinct())
    pairs = stored(pairs.select("start", "goal").distinct())
    key, ends = ["start", "goal"], {"ahead": "start", "back": "goal"}
    seen = {side: stored(pairs.select(end, F.col(end).alias("node")).distinct()) for side, end in ends.items()}
    front, depth = dict(seen), {"ahead": 0, "back": 0}
    reached = {side: None for side in seen}
    met = stored(pairs.where("start = goal").select(*key, F.col("start").alias("node"), F.lit(0).alias("length"), F.lit(0).alias("at")))
    sizes = {side: seen[side].count() for side in seen}
    while sum(depth.values()) < most and all(sizes.values()):
        side = min(sizes, key=sizes.get)
        end = ends[side]
        here, there = ("from", "to") if side == "ahead" else ("to", "from")
        todo = pairs.join(met.select(*key).distinct(), key, "left_anti")
        ways = front[side].join(todo.select(end).distinct(), end, "left_semi").join(step, F.col("node") == F.col(here)).select(end, F.col(here).alias("near"), F.col(there).alias("node"))
        depth[side] += 1
        ways = stored(ways.join(seen[side], [end, "node"], "left_anti").withColumn("depth", F.lit(depth[side])))
        reached[side] = ways if reached[side] is None else reached[side].unionByName(ways)
        front[side] = stored(ways.select(end, "node").distinct())
        sizes[side] = front[side].count()
        seen[side] = seen[side].unionByName(front[side])
        # a pair that is open meets at both fronts, or it would have met before
        now = _meeting(todo, front["ahead"], front["back"]).select(*key, "node", F.lit(sum(depth.values())).alias("length"), F.lit(depth["ahead"]).alias("at"))
        met = stored(met.unionByName(now))

    # the edges of all shortest paths, from the meeting nodes to both ends
    parts = []
    for side, end in ends.items():
        on = met.select(*key, "node", (F.col("at") if side == "ahead" else F.col("length") - F.col("at")).alias("depth"))
        if reached[side] is None:
            continue
        for d in range(depth[side], 0, -1):
            level = reached[side].where(F.col("depth") == d).drop("depth")
            used = stored(on.where(F.col("depth") == d).join(level, [end, "node"]).select(*key, "near", "node").distinct())
            parts.append(used.select(*key, *(("near", "node") if side == "ahead" else (F.col("node").alias("near"), F.col("near").alias("node")))))
            on = on.unionByName(used.select(*key, F.col("near").alias("node"), F.lit(d - 1).alias("depth"))).distinct()
    path = met.groupBy(*key).agg(F.min("length").alias("length")).withColumn("path", F.array("start"))
    if parts:
        ways = parts[0]
        for p in parts[1:]:
            ways = ways.unionByName(p)
        following = stored(ways.groupBy(*key, F.col("near").alias("now")).agg(F.min("node").alias("next")))
        for _ in range(sum(depth.values())):
            path = path.withColumn("now", F.element_at("path", -1)).join(following, [*key, "now"], "left")
            path = stored(path.select(*key, "length", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path")))
    return path


def steps_from_first(rows: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """(key, accepted): how many of a key's times a rule accepts that takes the first and then each that is ``gap`` or more after
    the last accepted one.

    The successor of a time is the first one a gap later: it is in the next bucket of the gap's width, or it is the first of
    the next bucket that has any. Accepted are the first time and its successors, which pointer doubling counts in
    logarithmic rounds; a time is a row, so a key with very many is no task of its own.
    """
    bucket = F.expr(f"(at - pmod(at, {gap})) div {gap}")
    times = stored(rows.select(key, F.col(at).cast("long").alias("at")).where("at is not null").distinct().withColumn("bucket", bucket))
    heads = times.groupBy(key, "bucket").agg(F.min("at").alias("head"))
    heads = stored(heads.withColumn("onward", F.lead("head").over(Window.partitionBy(key).orderBy("bucket"))))  # a row for each bucket that has any
    probes = times.select(key, (F.col("bucket") + 1).alias("bucket"), (F.col("at") + gap).alias("place"), "at")
    marks = times.select(key, "bucket", F.col("at").alias("place"), F.lit(None).cast("long").alias("at"))
    # a bucket has ``gap`` times at most, and as many probes; at one place the time comes before the probe
    later = Window.partitionBy(key, "bucket").orderBy(F.desc("place"), F.col("at").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = probes.unionByName(marks).withColumn("next", F.min(F.when(F.col("at").isNull(), F.col("place"))).over(later)).where("at is not null")
    here = heads.select(key, (F.col("bucket") + 1).alias("bucket"), F.col("onward").alias("onward0"))
    seen = seen.join(here, [key, "bucket"]).join(heads, [key, "bucket"], "left")
    beyond = F.when(F.col("head").isNotNull(), F.col("onward")).otherwise(F.col("onward0"))
    chain = stored(seen.select(key, "at", F.coalesce("next", beyond).alias("next"), F.lit(1).cast("long").alias("n")))
    longest = heads.groupBy(key).agg(F.count("*").alias("b")).agg(F.max("b")).first()[0] or 1
    span = 1
    while span < longest:  # at most one of a bucket is accepted
        onward = chain.select(key, F.col("at").alias("next"), F.col("next").alias("next2"), F.col("n").alias("n2"))
        chain = chain.join(onward, [key, "next"], "left").select(key, "at", F.col("next2").alias("next"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))
        span *= 2
    first = heads.groupBy(key).agg(F.min("head").alias("at"))
    return chain.join(first, [key, "at"]).select(key, F.col("n").alias("accepted"))

