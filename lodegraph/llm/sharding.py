"""Sharding in a random order by the two-pass external shuffle, in DataFrame functions only.

Pass one scatters whole records uniformly into buckets that fit a task's memory, by a seeded hash of the record and of its
number among equal records. Pass two shuffles each bucket by Fisher-Yates and writes it. The buckets in their order are a
uniform permutation of all records; shard s of S takes the places from ceil(s N / S) on, so shards' row counts are at
most one apart (law ``rows``) and slots have no gap.

Where a bucket begins is known before any record moves: records are hashed in a light pass, which counts the buckets and
measures whole records, so that a bucket's size is that of its rows in memory. Records that repeat are counted there too, carried once
and told apart by a number; a run of ``RUN`` numbers is a row, and runs are dealt to tasks before they are spelled out, so very many
copies of one record are no row and no task of their own. Buckets go to tasks in ranges: a shard is a few files, one slot range after the other.
Fisher-Yates is Spark's own ``shuffle`` of an array, drawing from a generator seeded for each partition; buckets come to it in
order, so a task that runs again writes the same files. Spark's committer keeps the files of one attempt only.

Defined cases: a null text has size 8 and the empty text's crc32; null ids are kept; with fewer rows than shards
some shards are empty; an empty table gives an empty result; other columns are kept in the shards. Columns ``shard`` and ``slot``
are added to them, with underscores in front where the table has columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, prefix_offsets, shared_dir, text_column

#: Bytes of the records of a bucket on average: a task holds a bucket a few times over.
BUCKET_BYTES = 8 << 20
OVERHEAD = 8
#: Bytes that a gathered row has besides its values.
ROW_BYTES = 120
#: Copies of a record that are spelled out from one row.
RUN = 4096
#: Repeated records whose hashes a broadcast may have; more are joined by a shuffle of both sides.
BROADCAST_ROWS = 500_000


def fisher_yates(items: Column, seed: int) -> Column:
    """The array in a random order: each element in turn changes places with one before it or itself."""
    return F.shuffle(items, F.lit(seed))


def _identity(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a whole record; maps, which have no hash, by their JSON."""
    columns = [F.to_json(docs[c]) if isinstance(docs.schema[c].dataType, T.MapType) else docs[c] for c in docs.columns]
    # a null counts for nothing in a hash, so their places stand beside
    nulls = F.concat(*[docs[c].isNull().cast("int").cast("string") for c in docs.columns])
    return F.xxhash64(nulls, *columns), F.xxhash64(F.lit(7), nulls, *columns)


def _bucket(seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "h1", "h2", "copy"), F.lit(buckets))


def _measured(docs: DataFrame) -> Column:
    """The bytes of a whole record: of texts and binary values their length, of nested ones that of their JSON."""
    total = F.lit(ROW_BYTES).cast("long")
    for f in docs.schema.fields:
        kind = f.dataType
        if isinstance(kind, T.StringType | T.BinaryType):
            total = total + F.coalesce(F.octet_length(docs[f.name]), F.lit(0))
        elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
            total = total + F.coalesce(F.octet_length(F.to_json(docs[f.name])), F.lit(0))
        else:
            total = total + 8
    return total


def _spelled(rows: DataFrame) -> DataFrame:
    """``rows`` (h1, h2, copies, ...) with ``copy`` from 1 to ``copies`` in place of that, in runs that are dealt to tasks first."""
    last = F.expr(f"(copies - 1) div {RUN}")
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    dealt = runs.repartition("h1", "h2", "run")
    first = F.col("run") * RUN
    return dealt.withColumn("copy", F.explode(F.sequence(first + 1, F.least(first + RUN, F.col("copies"))))).drop("run", "copies")


def numbered(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(h1, h2, copy, record): every record once, those that repeat with numbers from 1 on."""
    h1, h2 = _identity(docs)
    rows = docs.select(h1.alias("h1"), h2.alias("h2"), F.struct(*[docs[c] for c in docs.columns]).alias("record"))
    count = repeated.limit(BROADCAST_ROWS + 1).count()
    once = rows.withColumn("copy", F.lit(1).cast("long"))
    if not count:
        return once.select("h1", "h2", "copy", "record")
    keys = F.broadcast(repeated) if count <= BROADCAST_ROWS else repeated
    single = once.join(keys, ["h1", "h2"], "left_anti")
    # equal records are combined before they move
    many = rows.join(keys.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.first("record").alias("record"))
    return single.select("h1", "h2", "copy", "record").unionByName(_spelled(many).select("h1", "h2", "copy", "record"))


def own_names(columns: list[str]) -> tuple[str, str]:
    """Names for the shard and slot that no column has."""
    names = []
    for name in ("shard", "slot"):
        while name.lower() in [c.lower() for c in columns]:
            name = f"_{name}"
        names.append(name)
    return names[0], names[1]


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 11, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``docs`` as Parquet folders ``shard=0``, ... whose files hold the rows by slot; the written table."""
    spark = docs.sparkSession
    h1, h2 = _identity(docs)
    sizes = docs.select(h1.alias("h1"), h2.alias("h2"), _measured(docs).alias("bytes"))
    light = materialise(sizes.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.first("bytes").alias("bytes")))
    total = light.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("bytes") * F.col("copies")), F.lit(0)).alias("bytes")).first()
    # small enough for memory, and a few for each task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(-(-total["bytes"] // bucket_bytes), min(4 * tasks, total["n"]), 1)
    single = light.where("copies = 1").select("h1", "h2", F.lit(1).cast("long").alias("copy"))
    every = single.unionByName(_spelled(light.where("copies > 1").select("h1", "h2", "copies")))
    counts = every.select(_bucket(seed, buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    starts = prefix_offsets(materialise(counts), "bucket", "n", "base").select("bucket", "base")

    scattered = numbered(docs, light.where("copies > 1").select("h1", "h2")).withColumn("bucket", _bucket(seed, buckets))
    # a bucket's start travels with its records, as one more row of it
    rows = scattered.withColumn("base", F.lit(None).cast("long")).unionByName(materialise(starts), allowMissingColumns=True)
    ordered = rows.repartitionByRange("bucket").sortWithinPartitions("bucket", "h1", "h2", "copy")
    members = F.collect_list(F.when(F.col("base").isNull(), F.struct(F.struct("h1", "h2", "copy").alias("mark"), "record")))
    by_mark = lambda a, b: F.when(a["mark"] < b["mark"], -1).when(a["mark"] > b["mark"], 1).otherwise(0)
    gathered = ordered.groupBy("bucket").agg(F.max("base").alias("base"), F.array_sort(members, by_mark).alias("members"))
    placed = gathered.select("base", F.posexplode(fisher_yates(F.col("members"), seed)).alias("at", "m"))
    n = max(total["n"], 1)
    shard, slot = own_names(docs.columns)
    place = placed.select("m.record.*", (F.col("base") + F.col("at")).alias("__place"))
    where = place.withColumn(shard, F.expr(f"cast(cast(__place as decimal(30,0)) * {shards} div {n} as int)"))
    first = F.expr(f"cast((cast(`{shard}` as decimal(20,0)) * {n} + {shards - 1}) div {shards} as bigint)")
    out = where.withColumn(slot, F.col("__place") - first).drop("__place")
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).option("compression", "zstd").parquet(path)
    fields = [*docs.schema.fields, T.StructField(slot, T.LongType()), T.StructField(shard, T.IntegerType())]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def assign(docs: DataFrame, shards: int = 24, seed: int = 11, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shards into the shared folder and read them back: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    written = write_shards(docs, shared_dir(docs.sparkSession), shards, seed, text, bucket_bytes)
    shard, slot = own_names(docs.columns)
    body = text_column(written, text)
    return written.select(
        F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
