"""The full-text index against a scan: appended batches, pruning, and what a search reads."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from lodegraph.operators.fulltext import FullText, best
from lodegraph.sources.scratch import folder


def plain_scores(docs, words):
    """(key, score) by BM25 over texts of one key each."""
    bags = {k: Counter(re.findall("[a-z0-9_]+", (x or "").lower())) for k, x in docs}
    size = {k: sum(b.values()) for k, b in bags.items()}
    average = sum(size.values()) / len(bags)
    out = Counter()
    for w in words:
        d = sum(w in b for b in bags.values())
        for k, b in bags.items():
            if b[w]:
                out[k] += math.log(1 + (len(bags) - d + 0.5) / (d + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * size[k] / average))
    return dict(out)


def ranked(scores, k):
    return sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]


def some_docs(rng, n, start=0):
    words = [f"w{i}" for i in range(60)]
    return [(start + i, None if i % 50 == 7 else " ".join(rng.choices(words, weights=[60 - i for i in range(60)], k=rng.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_the_scan(spark, seed):
    rng = random.Random(seed)
    docs = some_docs(rng, 400)
    index = FullText(spark, folder(spark), buckets=4, window=16)
    assert index.search({"q": ["w1"]}, 3).count() == 0
    index.append(spark.createDataFrame(docs, "k long, x string").repartition(3), "k", "x")
    queries = {f"q{i}": [f"w{min(59, int(rng.expovariate(0.07)))}" for _ in range(rng.randint(1, 4))] for i in range(8)} | {"none": ["nowhere"]}
    got = index.search(queries, 5, seeds=1).collect()
    for q, words in queries.items():
        want = ranked(plain_scores(docs, words), 5)
        mine = sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])
        assert [r.key for r in mine] == [k for k, _ in want]
        assert [r.score for r in mine] == pytest.approx([s for _, s in want])
    assert {r.key: pytest.approx(r.score) for r in index.scores(["w3", "w50"]).collect()} == plain_scores(docs, ["w3", "w50"])


def test_appended_batch_is_seen_and_a_failed_one_is_not(spark):
    rng = random.Random(5)
    first, second = some_docs(rng, 100), some_docs(rng, 60, start=100)
    index = FullText(spark, folder(spark), window=16)
    frame = lambda d: spark.createDataFrame(d, "k long, x string")
    assert index.append(frame(first), "k", "x") == 0
    before = {r.key: r.score for r in index.scores(["w2"]).collect()}

    @F.udf("string")
    def broken(_):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        index.append(frame(second).withColumn("x", broken("x")), "k", "x")
    assert {r.key: r.score for r in index.scores(["w2"]).collect()} == before
    assert index.append(frame(second), "k", "x") == 1
    assert {r.key: pytest.approx(r.score) for r in index.scores(["w2"]).collect()} == plain_scores(first + second, ["w2"])
    got = sorted(index.search({"q": ["w2", "w40"]}, 7).collect(), key=lambda r: r["rank"])
    assert [r.key for r in got] == [k for k, _ in ranked(plain_scores(first + second, ["w2", "w40"]), 7)]


def scanned(df):
    """Rows that the plan's Parquet scans give out."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_a_search_reads_its_terms_and_windows_only(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(["common", f"rare{i // 500}", *(["peak"] * (9 if i == 777 else 1)), *rng.choices([f"v{j}" for j in range(300)], k=20)])) for i in range(4000)]
    index = FullText(spark, folder(spark), window=32, row_group=16 << 10)
    index.append(spark.createDataFrame(docs, "k long, x string").repartition(4), "k", "x")
    whole = index._postings(None).count()
    one = scanned(index._postings(["common"]))
    assert 125 <= one < whole / 8  # other folders, row groups and pages stay closed
    # one document stands out, so most windows of a word that is everywhere are never read
    wanted, terms = index.weights(spark.createDataFrame([("q", "peak")], "query string, term string"))
    bounds = index.bounds(wanted, terms)
    found, rest = index.survivors(bounds, wanted, terms, 1)
    assert bounds.count() == 125 and rest.count() == 0
    assert best(found, 1).first().key == 777
    assert scanned(index._postings(["peak"], [777 // 32])) < scanned(index._postings(["peak"]))


def test_whole_documents(spark, duck):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    index = FullText(spark, folder(spark), window=8)
    index.append(docs, "doc_id", "text")
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    got = index.search({"a": ["the", "license"], "b": ["und", "the", "permission"]}, 5).collect()
    for q, words in (("a", ["the", "license"]), ("b", ["und", "the", "permission"])):
        assert [r.key for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [k for k, _ in ranked(plain_scores(rows, words), 5)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_postings_move_by_window_only(spark, monkeypatch):
    """What counts and scores the postings of all queries is grouped where a window's blocks are; the results don't depend on the bounds."""
    from lodegraph.operators import fulltext

    rng = random.Random(3)
    docs = some_docs(rng, 300)
    index = FullText(spark, folder(spark), window=16)
    index.append(spark.createDataFrame(docs, "k long, x string").repartition(3), "k", "x")
    asked = spark.createDataFrame([(f"q{i}", f"w{i + j}") for i in range(6) for j in (0, 9, 30)], "query string, term string")
    many = index.matches(asked)
    wanted, terms = index.weights(asked)
    assert exchanges(many) == 1 and exchanges(index._scored(wanted, terms)) == 1
    has = lambda x, i: sum(f"w{i + j}" in (x or "").split() for j in (0, 9, 30))
    assert sorted(map(tuple, many.collect())) == sorted((f"q{i}", k, has(x, i)) for i in range(6) for k, x in docs if has(x, i))
    pruned = sorted((r["query"], r["rank"], r["key"]) for r in index.search(asked, 4, 1).collect())
    monkeypatch.setattr(fulltext, "PAIRS", 0)
    assert pruned == sorted((r["query"], r["rank"], r["key"]) for r in index.search(asked, 4, 1).collect())


def test_repeated_keys_are_one_document(spark):
    index = FullText(spark, folder(spark), window=16)
    index.append(spark.createDataFrame([(1, "a b"), (1, "a c d"), (2, "b")] * 2, "k long, x string").repartition(3), "k", "x")
    got = {(r.term, tuple(d)) for r in index._postings(None).collect() for d in r.docs}
    assert got == {("a", (1, 4, 3)), ("b", (1, 2, 2)), ("b", (2, 2, 1)), ("c", (1, 2, 3)), ("d", (1, 2, 3))}


def test_short_passages_are_looked_for(spark, tmp_path, monkeypatch):
    """Items of less than ten words count for the benchmark too; their passage may begin and end within a word, or have none."""
    import duckdb

    from lodegraph.plans import ORACLE, QUERIES, intents
    from lodegraph.sources.bindings import Tables

    texts = ["the quick brown fox jumps over the lazy dog by the old red barn door", "Quick brown foxes", "a \U0001f600\U0001f600 face, naïve café", "", None, "!!", "quick  brown", "x" * 40]
    items = ["quick brown fox", "ick brown fo", "Quick bro", "fox jumps over the lazy dog by the old red barn", "\U0001f600 face", "", "!!", None, "x" * 30, "ïve caf", "missing words here", "quick brown fox jumps over a lazy cat by"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(str(i), k) for i, x in enumerate(items) for k, y in enumerate(texts) if x is not None and y is not None and x in y}
    for held in (0, 1000):
        monkeypatch.setattr(intents, "_HELD", held, raising=False)
        assert {tuple(r) for r in intents.holders(Tables(spark, str(tmp_path))).collect()} == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    asked = con.execute(ORACLE["p25_retrieval_benchmark"]).fetchall()
    got = QUERIES["p25_retrieval_benchmark"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(asked) and any(r.recall == 1 and r.query == "2" for r in got)
