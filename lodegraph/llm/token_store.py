"""Token-id files with random access: directly addressable codes.

A file holds the ids of consecutive documents. Each id is cut into chunks of ``CHUNK_BITS``; level 0 has the lowest
chunk of every id, level k the next chunk of those ids that need it, in order. A bitmap beside each level says which
of its entries go on, and a rank directory counts the set bits before each block of ``RANK_BLOCK``: id i is
read by one look-up for each of its chunks, at ``i``, then ``rank(i)``, and so on; nothing is decoded on the way.

Layout (little-endian): magic ``DAC1``, header of unsigned 64-bit numbers (file number, documents, ids, levels), the
documents' ids (signed 64-bit, the lowest value for null) and end positions (unsigned 64-bit), then for each level its number of entries
(unsigned 64-bit), its chunks (unsigned 8-bit), its bitmap (bytes, low bit first, to a multiple of the block) and
its rank directory (unsigned 64-bit).

Tasks make the bytes of files and Spark's own writer puts them into the shared folder, a file for each record, followed by
one byte that the format doesn't use; so any file system that Spark reaches will do, and its committer keeps the files of one attempt only.
Documents are dealt to files by ranges of ``doc_id`` and sorted in them, so file numbers
follow ascending ids (nulls first, as Spark sorts them).

Defined cases: null text counts as empty, so only the end id is written; repeated rows are written repeatedly, each
with its own start; an empty table leaves no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import word_encoder
from .common import materialise, prefix_offsets, shared_dir, small_batches, text_column

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BLOCK = 512
#: Ids after which a file is closed; a longer document still stays whole.
FILE_IDS = 4_000_000
NULL_ID = -(1 << 63)


def pack(number: int, doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one file."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk = (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        padded = np.zeros(-(-len(rest) // RANK_BLOCK) * RANK_BLOCK, bool)
        padded[: len(rest)] = goes_on
        per_block = padded.reshape(-1, RANK_BLOCK).sum(1, dtype=np.uint64)
        directory = np.cumsum(per_block) - per_block
        levels += [struct.pack("<Q", len(rest)), chunk.tobytes(), np.packbits(padded, bitorder="little").tobytes(), directory.astype("<u8").tobytes()]
        rest = more[goes_on]
        if not len(rest):
            break
    head = MAGIC + struct.pack("<4Q", number, len(doc_ids), len(ids), len(levels) // 4)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), ends.astype("<u8").tobytes(), *levels])


class TokenFile:
    """Reader of one file: of its bytes, or of ranges that ``source(at, n)`` fetches, so that one id takes a few small reads."""

    def __init__(self, source: bytes | Callable[[int, int], bytes]):
        self.read = source if callable(source) else lambda at, n: source[at : at + n]
        if self.read(0, 4) != MAGIC:
            raise ValueError("not a token file")
        self.number, self.documents, self.n, count = struct.unpack("<4Q", self.read(4, 32))
        at = 36 + 16 * self.documents
        self.levels: list[tuple[int, int, int, int]] = []  # entries, places of chunks, bitmap and directory
        for _ in range(count):
            n = struct.unpack("<Q", self.read(at, 8))[0]
            blocks = -(-n // RANK_BLOCK)
            bitmap = at + 8 + n
            self.levels.append((n, at + 8, bitmap, bitmap + blocks * RANK_BLOCK // 8))
            at = bitmap + blocks * (RANK_BLOCK // 8 + 8)

    def _array(self, kind: str, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.read(at, n * np.dtype(kind).itemsize), kind)

    @property
    def doc_ids(self) -> np.ndarray:
        return self._array("<i8", 36, self.documents)

    @property
    def ends(self) -> np.ndarray:
        return self._array("<u8", 36 + 8 * self.documents, self.documents).astype(np.int64)

    def __getitem__(self, i: int) -> int:
        """Id ``i`` of the file by direct look-ups."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (_, chunks, bitmap, directory) in enumerate(self.levels):
            value |= self.read(chunks + i, 1)[0] << (CHUNK_BITS * k)
            block, inside = divmod(i, RANK_BLOCK)
            bits = int.from_bytes(self.read(bitmap + block * RANK_BLOCK // 8, RANK_BLOCK // 8), "little")
            if not bits >> inside & 1:
                break
            i = struct.unpack("<Q", self.read(directory + 8 * block, 8))[0] + (bits & (1 << inside) - 1).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(self.n, "<u4")
        where = np.arange(self.n)
        for k, (n, chunks, bitmap, directory) in enumerate(self.levels):
            out[where] |= self._array("u1", chunks, n).astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            where = where[np.unpackbits(self._array("u1", bitmap, directory - bitmap), count=n, bitorder="little").astype(bool)]
        return out


def opened(spark: SparkSession, path: str) -> TokenFile:
    """A file of any file system that Spark reaches, read by ranges."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)

    def read(at: int, n: int) -> bytes:
        stream.seek(at)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

    return TokenFile(read)


def write(docs: DataFrame, folder: str, path: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write token files into ``folder``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), text_column(docs, text).alias("text"))
    # repeats of one id, or rows without one, are told apart by their texts, so they are no task of their own
    ordered = rows.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, 0
        encode = word_encoder(path).encode_batch
        last = np.array([end], "<u4")
        keys: list[int] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal made, held
            ends = np.cumsum([len(x) for x in ids])
            raw = pack((part << 32) + made, np.array(keys, np.int64), ends, np.concatenate(ids))
            made, held = made + 1, 0
            keys.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["content"])

        for batch in batches:
            for k, found in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                keys.append(NULL_ID if k is None else k)
                ids.append(np.concatenate([found, last]))
                held += len(ids[-1])
                if held >= FILE_IDS:
                    yield close()
        if keys:
            yield close()

    files = ordered.mapInArrow(run, "content binary")
    # the text writer puts down a value's bytes as they are
    files.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").option("lineSep", "\n").text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(file, doc_id, at, ids binary) of all documents from the files of ``folder``; ``at`` counts from the file's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                file = TokenFile(raw.as_py())
                ids, doc_ids, ends = file.all(), file.doc_ids, file.ends
                begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                for at in range(0, len(ends), 256):
                    to = min(at + 256, len(ends))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(to - at, file.number, np.int64)),
                            pa.array(doc_ids[at:to], mask=doc_ids[at:to] == NULL_ID),
                            pa.array(begins[at:to]),
                            pa.array([ids[b:e].tobytes() for b, e in zip(begins[at:to], ends[at:to], strict=True)], pa.binary()),
                        ],
                        names=["file", "doc_id", "at", "ids"],
                    )

    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
    return files.mapInArrow(run, "file long, doc_id long, at long, ids binary")


def file_starts(manifest: DataFrame) -> DataFrame:
    """(file, ids) -> (file, base): the ids before each file, in the order of partitions and of the files of each."""
    parts = manifest.withColumn("part", F.shiftright("file", 32))
    totals = parts.groupBy("part").agg(F.sum("ids").alias("ids"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("ids").over(inside), F.lit(0))
    return parts.join(prefix_offsets(totals, "part", "ids", "base").select("part", "base"), "part").select("file", (F.col("base") + own).alias("base"))


def stored_documents(docs: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents as token files and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    write(docs, folder, path, end, key, text)
    # only counts and sums meet the files' starts, not the ids
    sizes = ("file", "doc_id", "at", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    found = materialise(read(spark, folder).select(*sizes))
    manifest = materialise(found.groupBy("file").agg(F.sum("n_tokens").alias("ids")))
    return found.join(file_starts(manifest), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
