"""A full-text index: postings by term in blocks with their maxima, written once, appended to by batches, searched by block-max pruning.

``folder/postings`` has a row for each term, batch and window of ``WINDOW`` consecutive keys: how many documents, the largest term
frequency and the least length among them, and the postings (key, frequency, length) themselves. Rows are dealt to folders by
a hash of the term and sorted by (term, window) in files, a file for each task's windows, so a search opens the folders of its terms and skips the
row groups and pages of others. ``folder/totals`` has the documents and words of each batch and is written last: a batch without totals
doesn't count, so a failed append leaves nothing that a search sees.

A search is for many queries at once. From the blocks' headers alone it has an upper bound of what any document in a window can
score, as the bound of a block (largest frequency, least length) holds for any average length; it reads the ``SEEDS`` best windows of each
query, takes the k-th score found there and then reads only those windows whose bound isn't below it. All blocks of a document are in
one window, so every document that could be among the best is scored in full.

Keys are integers; rows without one are left out; repeats of a key in a batch are one document with the words of all and the length of
the longest, those in further batches add to its score. A document without words counts for the averages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import stored

WINDOW = 1024
BUCKETS = 16
SEEDS = 4
#: Terms or windows that go into a scan's filter as values; more are joined only.
PUSHED = 200
#: Windows that a task puts together, about.
TASK_WINDOWS = 8
#: Windows of queries that restrict a search's second reading, at most.
PAIRS = 1_000_000
#: Blocks in a page of a file at most; pages of other windows are skipped by the pages' index.
PAGE_ROWS = 50
K1, B = 1.2, 0.75
_POSTINGS = "term string, window long, n long, most long, least long, docs array<struct<key:long,tf:long,dl:long>>, batch int, bucket int"
_SLACK = 1e-9


class FullText:
    """The index in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, window: int = WINDOW, row_group: int = 4 << 20):
        self.spark, self.folder, self.buckets, self.window, self.row_group = spark, folder, buckets, window, row_group

    def _totals(self) -> list[tuple[int, int, int]]:
        """(batch, documents, words) of each batch that is complete."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return []
        found = self.spark.read.schema("docs long, words long, batch int").parquet(f"{self.folder}/totals")
        return [tuple(r) for r in found.select("batch", "docs", "words").collect()]  # one row a batch

    def append(self, docs: DataFrame, key: str, text: str) -> int:
        """Add ``docs`` as one more batch, whose number is returned."""
        batch = max((b for b, *_ in self._totals()), default=-1) + 1
        rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), X.tokens(F.col(text)).alias("w"))
        # a document moves once, to its window's task; its postings are counted and put together there, so none moves on its own
        windows = rows.count() // self.window + 1
        tasks = max(min(windows, self.spark.sparkContext.defaultParallelism), windows // TASK_WINDOWS)
        local = rows.withColumn("window", F.floor(F.col("key") / self.window)).repartition(tasks, "window")
        each = local.select("window", "key", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term"))
        counted = each.groupBy("window", "term", "key").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
        blocks = counted.groupBy("window", "term").agg(  # ``window`` keys at most
            F.count("*").alias("n"), F.max("tf").alias("most"), F.min("dl").alias("least"), F.array_sort(F.collect_list(F.struct("key", "tf", "dl"))).alias("docs")
        )
        dealt = blocks.select("term", "window", "n", "most", "least", "docs", self._bucket(F.col("term")).alias("bucket")).sortWithinPartitions("bucket", "term", "window")
        dealt.write.mode("overwrite").partitionBy("bucket").option("parquet.block.size", self.row_group).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.folder}/postings/batch={batch}")
        totals = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("w").cast("long")), F.lit(0)).alias("words"))
        totals.write.mode("overwrite").parquet(f"{self.folder}/totals/batch={batch}")
        return batch

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.hash(term), F.lit(self.buckets))

    def _postings(self, terms: Sequence[str] | None, windows: Sequence[int] | None = None) -> DataFrame:
        """The blocks of complete batches; few terms and windows reach the scan as values."""
        rows = self.spark.read.schema(_POSTINGS).option("basePath", f"{self.folder}/postings").parquet(f"{self.folder}/postings")
        rows = rows.where(F.col("batch").isin([b for b, *_ in self._totals()]))
        if terms is not None:
            rows = rows.where(F.col("term").isin(*terms)).where(F.col("bucket").isin(*[self._bucket(F.lit(t)) for t in terms]))
        if windows:
            rows = rows.where(F.col("window").isin(*windows)).where(F.col("window").between(min(windows), max(windows)))
        return rows

    def _impact(self, tf: str, dl: str) -> Column:
        totals = self._totals()
        docs, words = sum(d for _, d, _ in totals), sum(w for *_, w in totals)
        average = words / docs if words else 1.0
        f = F.col(tf).cast("double")
        return f * (K1 + 1) / (f + K1 * (1 - B + B * F.col(dl) / F.lit(average)))

    def weights(self, queries: DataFrame) -> tuple[DataFrame, list[str] | None]:
        """(query, term), repeats included, -> (query, term, w) for terms that the index has, and the terms where they are few."""
        words = queries.groupBy("query", "term").agg(F.count("*").alias("times"))
        few = [r.term for r in words.select("term").distinct().limit(PUSHED + 1).collect()]
        terms = few if len(few) <= PUSHED else None
        heads = self._postings(terms).select("term", "n")
        df = heads.groupBy("term").agg(F.sum("n").alias("d"))
        n = F.lit(sum(d for _, d, _ in self._totals()))
        idf = F.log(1 + (n - F.col("d") + 0.5) / (F.col("d") + 0.5))
        return stored(words.join(df, "term").select("query", "term", (F.col("times") * idf).alias("w"))), terms

    def _scored(self, wanted: DataFrame, terms: list[str] | None, windows: list[int] | None = None, pairs: DataFrame | None = None) -> DataFrame:
        """(query, term, w) -> (query, key, score) from the blocks' postings, of the given ``pairs`` (query, window) only where there are any."""
        each = self._asked(wanted, terms, windows, "docs")
        if pairs is not None:
            each = each.join(F.broadcast(pairs), ["query", "window"], "left_semi")  # ``PAIRS`` rows
        each = each.select("query", "window", "w", F.explode("docs").alias("d")).select("query", "window", F.col("d.key").alias("key"), "w", F.col("d.tf").alias("tf"), F.col("d.dl").alias("dl"))
        return each.groupBy("query", "window", "key").agg(F.sum(F.col("w") * self._impact("tf", "dl")).alias("score")).drop("window")

    def _asked(self, wanted: DataFrame, terms: list[str] | None, windows: list[int] | None, docs: str) -> DataFrame:
        """(query, term, w, window, docs): blocks by window, so that a block moves once for all queries and a document's terms meet where they are."""
        blocks = self._postings(terms, windows).select("term", "window", F.col(docs).alias("docs"))
        if terms is None:
            blocks = blocks.join(wanted.select("term").distinct(), "term", "left_semi")
        return blocks.repartition("window").join(wanted, "term")

    def scores(self, words: Sequence[str]) -> DataFrame:
        """(key, score) of every document that has one of ``words``."""
        if not self._totals():
            return self.spark.createDataFrame([], "key long, score double")
        wanted, terms = self.weights(_queries(self.spark, {"": words}))
        return self._scored(wanted, terms).select("key", "score")

    def matches(self, queries: DataFrame) -> DataFrame:
        """(query, key, words): every document with one of a query's terms, and with how many."""
        if not self._totals():
            return self.spark.createDataFrame([], "query string, key long, words long")
        wanted, terms = self.weights(queries)
        each = self._asked(wanted, terms, None, "docs.key").select("query", "window", "term", F.explode("docs").alias("key"))
        return each.groupBy("query", "window", "key").agg(F.count("*").alias("words")).drop("window")

    def bounds(self, wanted: DataFrame, terms: list[str] | None) -> DataFrame:
        """(query, window, bound): from the blocks' headers, what no document of a window can exceed."""
        heads = self._postings(terms).select("term", "window", self._impact("most", "least").alias("bound"))
        most = heads.groupBy("term", "window").agg(F.sum("bound").alias("bound"))
        return most.join(wanted, "term").groupBy("query", "window").agg(F.sum(F.col("w") * F.col("bound")).alias("bound"))

    def survivors(self, bounds: DataFrame, wanted: DataFrame, terms: list[str] | None, k: int, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
        """(the scores in each query's best windows, the other windows that can hold one of its ``k`` best)."""
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "window"))
        first = stored(bounds.withColumn("rn", place).where(F.col("rn") <= seeds).select("query", "window"))
        found = stored(self._scored(wanted, terms, self._few(first), first))
        kth = best(found, k).groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(0.0)).alias("least"))
        rest = bounds.join(first, ["query", "window"], "left_anti").join(kth, "query", "left")
        return found, stored(rest.where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - _SLACK).select("query", "window"))

    def _few(self, pairs: DataFrame) -> list[int] | None:
        found = [r.window for r in pairs.select("window").distinct().limit(PUSHED + 1).collect()]
        return found if len(found) <= PUSHED else None

    def search(self, queries: DataFrame | dict[str, Sequence[str]], k: int, seeds: int = SEEDS) -> DataFrame:
        """(query, key, score, rank) of the ``k`` best documents of each query; ``queries`` has (query, term)."""
        if isinstance(queries, dict):
            queries = _queries(self.spark, queries)
        if not self._totals():
            return self.spark.createDataFrame([], "query string, key long, score double, rank int")
        wanted, terms = self.weights(queries)
        found, rest = self.survivors(stored(self.bounds(wanted, terms)), wanted, terms, k, seeds)
        pairs = rest.count()
        if pairs > PAIRS:  # more than a broadcast should have: every window is scored, those of ``found`` again
            return best(self._scored(wanted, terms), k)
        if pairs:
            found = found.unionByName(self._scored(wanted, terms, self._few(rest), rest))
        return best(found, k)


def _queries(spark: SparkSession, queries: dict[str, Sequence[str]]) -> DataFrame:
    return spark.createDataFrame([(q, w.lower()) for q, words in queries.items() for w in words], "query string, term string")


def best(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best keys of each query with their ``rank``; equal scores (to 9 digits) by key. Limits each task's rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "key"))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)


_BUILT: dict[tuple, str] = {}


def index_of(spark: SparkSession, rows: DataFrame, key: str, text: str, folder) -> FullText:
    """The application's index of ``rows``, built on the first call and again when the files under ``rows`` are others."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    mark = files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    name = (spark.sparkContext.applicationId, key, text, *mark)
    if name not in _BUILT:
        index = FullText(spark, folder(spark))
        index.append(rows, key, text)
        _BUILT[name] = index.folder
    return FullText(spark, _BUILT[name])
