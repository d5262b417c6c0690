"""The pipeline's stages against brute force, each on its own input."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from lodegraph.llm import line_dedup, near_copies, simhash, toxicity
from test_llm_operators import DOC, ODD, brute_classes, brute_lines, texts


def test_stages_and_their_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    first = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    gone = {r["doc_id"] for r in toxicity.scores(docs, labels).where("predicted = 1").collect()}
    assert {i for i, _ in texts(first)} == {i for i, _ in texts(docs)} - gone
    second = corpus_pipeline.drop_lines(spark, first, SMALL)
    assert sorted(texts(second)) == sorted(brute_lines(texts(first)).elements())
    third = corpus_pipeline.drop_near_duplicates(spark, second, SMALL)
    kept = sorted(i for i, _, c in brute_classes(texts(second)) if i == c)
    assert sorted(i for i, _ in texts(third)) == kept
    assert first.columns == second.columns == third.columns == docs.columns
    last = corpus_pipeline.pack_sequences(spark, third, SMALL)
    assert {r["doc_id"] for r in last.collect()} == set(kept)


def test_run_is_its_stages(spark):
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert packed and all(r["offset"] + r["length"] <= 2048 for r in packed)


@pytest.mark.parametrize("rows", [[], ODD])
def test_stages_take_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, DOC).withColumn("h", F.lit(1)).withColumn("component_id", F.lit(2))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        if i < 3:
            assert docs.columns == [*DOC.replace(" long", "").replace(" string", "").split(", "), "h", "component_id"]
    docs.collect()


def test_one_of_each_class_stays(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "a b c d"), (4, "A b c d")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_earliest(docs).collect()) == [1, 3]


@pytest.mark.parametrize(("crowd", "each"), [(32, 2), (2, 0), (2, 1000)])
def test_near_copies_against_brute_force(spark, monkeypatch, crowd, each):
    """Copies with scattered edits, a crowd among them: the stage keeps the least of each component at 0.8 or more."""
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    monkeypatch.setattr(near_copies, "EACH", each)
    random.seed(5)
    rows, near = [], {0.8: 0, 0.9: 0, 0.95: 0}
    for base in range(40):
        words = [f"w{random.randrange(50_000)}" for _ in range(400)]
        rows.append(" ".join(words))
        for edits in [*range(1, 20, 2)] if base else [*range(1, 20, 2)] * 8:
            copy = list(words)
            for at in random.sample(range(400), edits):
                copy[at] = f"x{random.randrange(50_000)}"
            rows.append(" ".join(copy))
    rows += ["", "one two", "One  two", "one two three"]
    sets = [set(near_copies.shingles(x).tolist()) for x in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
            for k in near:
                near[k] += 5 * both < 5 * len(sets[a] | sets[b]) and both >= k * len(sets[a] | sets[b])
    assert all(near.values())
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()}
    assert kept == {root(i) for i in range(len(rows))}


def test_candidates_come_by_fingerprint_too(spark):
    """Without any band the pigeonring join finds near copies; what it finds is verified on the whole sets."""
    words = [f"w{i}" for i in range(600)]
    rows = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"v{i}" for i in range(600)), "a b c d e", "a b c d f"]
    base = near_copies.materialise(near_copies.sets(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).withColumn("bands", F.array().cast("array<long>"))
    of = {r["fp"]: r["key"] for r in base.select("key", "fp").collect()}
    assert {tuple(sorted((of[r.u], of[r.v]))) for r in near_copies.links(base).collect()} == {(0, 1)}


def test_pairs_are_not_broadcast(spark):
    """Files of hashes that repeat are far smaller than their rows, so joins that make pairs of them don't send a side to the driver."""
    plan = lambda found: found._jdf.queryExecution().executedPlan().toString()
    base = near_copies.sets(spark.createDataFrame([(i, f"a b c d e f {i % 3}") for i in range(9)], "doc_id long, text string"))
    some = base.select("fp", F.size("shingles").alias("n"), F.col("fp").alias("label"))
    assert "Broadcast" not in plan(near_copies._sharing_prefixes(some, some, base))
    kind = "h1 long, h2 long, first struct<doc:long,version:long,place:int>, shared array<int>, line string"
    lines = spark.createDataFrame([(i, i, (i, i, 0), [0, 1, 2, 3], f"a b c d e {i}") for i in range(9)], kind)
    assert "Broadcast" not in plan(line_dedup.near_later(line_dedup.variants(lines), lines))
