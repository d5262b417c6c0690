"""Toxicity by two class-conditional Kneser-Ney models of words as character sequences, with shared backoff counts.

A word is a run of non-space characters, lower-cased and without the punctuation at its ends; it is read as
characters between a start and an end mark, each after up to ``ORDER - 1`` characters of the same word. A class counts the
pairs of a text and a word of it in which an n-gram occurs. From each count up to ``DISCOUNT`` is taken, and what a history
loses goes to the shared lower orders, an interpolated Kneser-Ney distribution by continuation counts over all documents,
labelled or not: P_k(c | h) = (max(n_k(hc) - DISCOUNT, 0) + lost_k(h) P_shared(c | h')) / n_k(h). Each history's
probabilities sum to 1 in either class. A history that a class hasn't seen backs off wholly, so a rare expression is judged
by the stem that it shares with others.

Toxic texts are mostly ordinary words, so the toxic class's word model is ``MIXED`` parts of the toxic estimate and the rest
of the ordinary one. A text's evidence is the difference of its log-likelihoods under both classes for each of its words,
repeats included: both are normalised by length. A logistic function of the evidence, on an asinh scale as evidence has a
long tail, is fitted on labelled rows that gave no counts.

What is counted: n-grams of the classes over all labelled rows outside the held-out fold, but for the sample of the
logistic fit (at most ``CALIBRATION`` rows of each class, those of least hash in a fifth of the rows); continuation counts
over every document. All of it is aggregated and joined by Spark. Up to ``MODEL_ROWS`` n-grams and histories of the labelled rows are
broadcast; a larger model is joined to the distinct words instead, with the same results.

Defined cases: null and empty text have no evidence, so their score is that of the offset; null labels don't
train; of repeated labels of an id the toxic one counts; repeated rows are scored each; with no labelled row of one class every score is 0;
an empty table gives an empty result; other columns are ignored (``scores``) or kept (``keep_ordinary``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, spread, text_column

#: Labelled rows of each class that the logistic function is fitted on, at most.
CALIBRATION = 1000
#: Characters of an n-gram.
ORDER = 5
#: Taken from each count of a class, and from each continuation count.
DISCOUNT, SHARED_DISCOUNT = 2.0, 0.75
#: The toxic estimate's share in the toxic class's word model.
MIXED = 0.001
FOLDS, HELD_OUT = 5, 0
#: Rows of a model that a broadcast may have, and labels: some 100 MB and 8 MB.
MODEL_ROWS, LABEL_ROWS = 1_000_000, 500_000
#: Words a task counts before it hands on their n-grams, and words a worker remembers; memory only.
HELD_WORDS, CACHE_WORDS = 300_000, 500_000
_EDGES = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) + "¡¿«»„“”‘’…–—"
START, END = "\x02", "\x03"
#: A ratio beyond this says no more: exp of it is near the largest number.
LARGEST = 700.0


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; rows in fold HELD_OUT never train."""
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def words_of(text: str) -> list[str]:
    """The words of a text in order, repeats included."""
    return [w for w in (x.strip(_EDGES) for x in text.lower().split()) if w]


def distinct_words(text: str) -> set[str]:
    return set(words_of(text))


def ngrams(word: str) -> Iterator[tuple[str, str]]:
    marked = START + word + END
    for i in range(1, len(marked)):
        yield marked[max(0, i - ORDER + 1) : i], marked[i]


def label_rows(labels: DataFrame) -> DataFrame:
    """(id, toxic, weight) of labelled rows outside the held-out fold, one for each id; ``weight``, of the rows of the
    logistic fit only, is how many rows of its class each of them stands for."""
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where("toxic in (0, 1) and id is not null").where(fold(F.col("id")) != HELD_OUT)
    own = materialise(own.groupBy("id").agg(F.max("toxic").alias("toxic")))
    order = (F.xxhash64("id"), F.col("id"))
    some = own.where(F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(5)) == 0)
    sizes = {r["toxic"]: r["count"] for r in some.groupBy("toxic").count().collect()}  # two classes
    picked = [some.where(F.col("toxic") == k).orderBy(*order).limit(CALIBRATION).select("id", F.lit(max(1.0, sizes.get(k, 0) / CALIBRATION)).alias("weight")) for k in (0, 1)]
    # 2 * CALIBRATION ids at most
    return materialise(own.join(F.broadcast(picked[0].unionByName(picked[1])), "id", "left"))


def with_labels(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(text, toxic, weight) of all documents; the last two null where there is no label to learn from."""
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("id"), text_column(docs).alias("text")))
    small = labelled.limit(LABEL_ROWS + 1).count() <= LABEL_ROWS
    return rows.join(F.broadcast(labelled) if small else labelled, "id", "left").select("text", "toxic", "weight")


def gram_counts(rows: DataFrame) -> DataFrame:
    """``with_labels`` -> (history, char, ordinary, toxic): every n-gram of the corpus, with the counts of both classes.

    A task counts its words first and cuts each distinct one once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def cut() -> pa.RecordBatch:
            found: dict[tuple[str, str], list[int]] = {}
            for word, (ordinary, toxic) in held.items():
                for gram in ngrams(word):
                    n = found.setdefault(gram, [0, 0])
                    n[0], n[1] = n[0] + ordinary, n[1] + toxic
            held.clear()
            columns = ([h for h, _ in found], [c for _, c in found], [n[0] for n in found.values()], [n[1] for n in found.values()])
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["history", "char", "ordinary", "toxic"])

        for batch in batches:
            for text, toxic, weight in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts = toxic is not None and weight is None
                for word in distinct_words(text):
                    n = held.setdefault(word, [0, 0])
                    if counts:
                        n[toxic] += 1
            if len(held) > HELD_WORDS:
                yield cut()
        if held:
            yield cut()

    grams = rows.mapInArrow(run, "history string, char string, ordinary long, toxic long")
    return grams.groupBy("history", "char").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def continuations(grams: DataFrame) -> DataFrame:
    """(tail, char, n, total, kinds): of each n-gram without its first characters the number of characters it was seen
    after, and of its history the sum of those numbers and the number of characters that follow."""
    cut = F.explode(F.sequence(F.lit(2), F.length("history") + 1)).alias("at")
    tails = grams.select("history", "char", cut).select(F.expr("substring(history, at)").alias("tail"), "char", F.expr("substring(history, at - 1, 1)").alias("before")).distinct()
    counts = materialise(tails.groupBy("tail", "char").agg(F.count("*").alias("n")))
    return counts.join(counts.groupBy("tail").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "tail")


def with_shared(seen: DataFrame, grams: DataFrame) -> DataFrame:
    """``seen`` n-grams with ``shared``: P_shared(char | history without its first character).

    The orders build on each other from the shortest, which backs off to all characters and one unknown one alike.
    """
    parts = materialise(continuations(grams))
    characters = F.broadcast(grams.agg((F.countDistinct("char") + 1).alias("characters")))  # one row
    joined, shared = seen.crossJoin(characters), 1.0 / F.col("characters")
    for k in range(ORDER - 1, 0, -1):  # the histories that end k characters into this one, from none left on
        names = {c: f"{c}{k}" for c in ("tail", "n", "total", "kinds")}
        order = parts.select("char", *[F.col(c).alias(x) for c, x in names.items()])
        joined = joined.withColumn(names["tail"], F.expr(f"if(length(history) >= {k}, substring(history, {k + 1}), null)")).join(order, ["char", names["tail"]], "left")
        n, total, kinds = (F.col(names[c]) for c in ("n", "total", "kinds"))
        built = (F.greatest(n - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * kinds * shared) / total
        shared = F.when(total.isNull(), shared).otherwise(built)  # null: this history is shorter than that
    return joined.select(*seen.columns, shared.alias("shared"))


def probabilities(grams: DataFrame) -> DataFrame:
    """(history, char, shared, ordinary_p, toxic_p, ordinary_rest, toxic_rest) of the n-grams with a class count; the last
    two are what each class leaves to the shared distribution after the history."""
    seen = grams.where("ordinary + toxic > 0")
    lost = lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT)))
    sums = seen.groupBy("history").agg(F.sum("ordinary").alias("n0"), F.sum("toxic").alias("n1"), lost("ordinary").alias("lost0"), lost("toxic").alias("lost1"))
    joined = with_shared(seen, grams).join(sums, "history")

    def p(k: int, count: str) -> list[Column]:
        own = F.greatest(F.col(count) - DISCOUNT, F.lit(0.0))
        return [F.when(F.col(f"n{k}") > 0, (own + F.col(f"lost{k}") * F.col("shared")) / F.col(f"n{k}")).otherwise(F.col("shared")), F.when(F.col(f"n{k}") > 0, F.col(f"lost{k}") / F.col(f"n{k}")).otherwise(1.0)]

    (ordinary, ordinary_rest), (toxic, toxic_rest) = p(0, "ordinary"), p(1, "toxic")
    return joined.select("history", "char", "shared", ordinary.alias("ordinary_p"), toxic.alias("toxic_p"), ordinary_rest.alias("ordinary_rest"), toxic_rest.alias("toxic_rest"))


def ratios(grams: DataFrame) -> DataFrame:
    """(history, char, ratio): toxic minus ordinary log-likelihood; with a null char, of every other character after the history."""
    found = materialise(probabilities(grams))
    own = found.select("history", "char", F.log(F.col("toxic_p") / F.col("ordinary_p")).alias("ratio"))
    rest = found.select("history", F.lit(None).cast("string").alias("char"), F.log(F.col("toxic_rest") / F.col("ordinary_rest")).alias("ratio")).distinct()
    return own.unionByName(rest.where("ratio <> 0"))


def word_evidence(ratio: float) -> float:
    """Log of the mixed toxic model's probability over the ordinary one's, for a word with the toxic estimate's ``ratio``."""
    return math.log1p(MIXED * math.expm1(min(ratio, LARGEST)))


class Scorer:
    """Evidence of texts by a broadcast model; words are remembered."""

    def __init__(self, table: pa.Table):
        rows = zip(*(table[c].to_pylist() for c in ("history", "char", "ratio")), strict=True)
        self.seen = {(h, c): r for h, c, r in rows}
        self.known: dict[str, float] = {}

    def ratio(self, word: str) -> float:
        get = self.seen.get
        return math.fsum(r if (r := get((h, c))) is not None else get((h, None), 0.0) for h, c in ngrams(word))

    def word(self, word: str) -> float:
        if (found := self.known.get(word)) is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            found = self.known[word] = word_evidence(self.ratio(word))
        return found

    def evidence(self, text: str) -> float:
        words = words_of(text)
        return math.fsum(map(self.word, words)) / len(words) if words else 0.0


@dataclass
class Model:
    """The ratios, as a broadcast scorer or, beyond MODEL_ROWS, as a table; and how evidence becomes a score."""

    table: DataFrame
    scorer: Scorer | None
    scale: float = 1.0
    slope: float = 0.0
    offset: float = 0.0

    def margin(self, evidence: Column) -> Column:
        return F.asinh(evidence / self.scale) * self.slope + self.offset


def evidence_by_broadcast(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """``rows`` with ``text`` in place of which stands ``evidence``."""
    shared = rows.sparkSession.sparkContext.broadcast(scorer)
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = shared.value.evidence
        for batch in batches:
            found = pa.array([evidence(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*kept, "evidence"])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.select(*kept, "text").mapInArrow(run, f"{kinds}evidence double")


def evidence_by_join(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The same by joins: n-grams of the distinct words with the model, words with their sums, texts with their words."""
    numbered = materialise(rows.withColumn("__row", F.monotonically_increasing_id()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column(1)):
                words = words_of(x.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(words), pa.int64()), pa.array(words, pa.string())], names=["row", "word"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(w, h, c) for w in batch.column(0).to_pylist() for h, c in ngrams(w)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.string())] * 3, names=["word", "history", "char"])

    words = materialise(numbered.select("__row", "text").mapInArrow(split, "row long, word string").groupBy("row", "word").agg(F.count("*").alias("n")))
    grams = words.select("word").distinct().mapInArrow(cut, "word string, history string, char string")
    own = table.where("char is not null")
    rest = table.where("char is null").select("history", F.col("ratio").alias("rest"))
    found = grams.join(own, ["history", "char"], "left").join(rest, "history", "left")
    summed = found.groupBy("word").agg(F.sum(F.coalesce("ratio", "rest", F.lit(0.0))).alias("ratio"))
    per_word = F.log1p(MIXED * F.expm1(F.least(F.col("ratio"), F.lit(LARGEST))))
    per_text = words.join(summed, "word").groupBy("row").agg((F.sum(F.col("n") * per_word) / F.sum("n")).alias("evidence"))
    kept = [numbered[c] for c in rows.columns if c != "text"]
    return numbered.join(per_text, F.col("__row") == F.col("row"), "left").select(*kept, F.coalesce("evidence", F.lit(0.0)).alias("evidence"))


def _evidence(rows: DataFrame, model: Model) -> DataFrame:
    return evidence_by_broadcast(rows, model.scorer) if model.scorer else evidence_by_join(rows, model.table)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Count and join the model in Spark, then fit the score on the calibration rows; None without both classes."""
    small_batches(docs.sparkSession)
    labelled = label_rows(labels)
    if labelled.select("toxic").distinct().count() < 2:
        return None
    rows = with_labels(docs, labelled)
    table = materialise(ratios(materialise(gram_counts(rows))))
    small = table.limit(MODEL_ROWS + 1).count() <= MODEL_ROWS
    model = Model(table, Scorer(table.toArrow()) if small else None)
    sample = rows.where("weight is not null").select("toxic", "weight", "text")
    seen = _evidence(materialise(sample), model).toArrow()  # 2 * CALIBRATION ids at most
    x, y, weight = (seen[c].to_numpy() for c in ("evidence", "toxic", "weight"))
    ordinary = np.abs(x[y == 0])
    model.scale = max(float(np.median(ordinary)) if len(ordinary) else 0.0, 1e-9)
    model.slope, model.offset = logistic(np.arcsinh(x / model.scale), y, weight)
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of P(y = 1) by Newton's method on weighted rows; the slope isn't negative."""
    if not len(x) or y.min() == y.max():
        return 1.0, -1.0
    w, share = np.array([0.0, 0.0]), weight / weight.sum()
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (share * (p - y)) + ridge * np.array([w[0], 0.0])
        hessian = design.T @ (design * (share * p * (1 - p))[:, None]) + np.diag([ridge, 1e-12])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0.0)), float(w[1])


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    if model is None:
        return docs.select("doc_id", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    found = _evidence(spread(docs.select("doc_id", text_column(docs).alias("text"))), model)
    margin = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.margin(F.col("evidence"))))
    scored = found.withColumn("score", 1 / (1 + F.exp(-margin)))
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all columns as they were; each row is judged on its own text."""
    model = fit(docs, labels)
    if model is None:
        return docs
    if model.scorer is None:
        kept = [F.col(c).alias(f"__{i}") for i, c in enumerate(docs.columns)]
        found = evidence_by_join(docs.select(*kept, text_column(docs).alias("text")), model.table)
        return found.where(model.margin(F.col("evidence")) < 0).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer)
    score: Callable = F.pandas_udf(lambda texts: texts.map(shared.value.evidence), "double")
    rows = spread(docs)
    return rows.where(model.margin(score(text_column(rows))) < 0)
