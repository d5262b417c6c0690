"""WARC archives of web pages, and their deduplication by revisit records.

An archive's records are gzip members of their own, as the format recommends, so each can be read by its place alone. Tasks make
the bytes of files of some ``SEGMENT`` and Spark's writer puts them down, a file for each value; what it writes after a value
is an empty member, so files are whole gzip streams on any file system that Spark reaches.

``deduplicate`` reads archives in two passes. The first takes headers only: they are shuffled by payload digest and combined
before that, so many copies of a payload are one row by then, and each copy's header is joined with the response that it shall
refer to (a join that adaptive execution splits where one payload has very many copies). The second takes whole records,
joins what became of each by its file and place, and writes archives in which all headers are fresh: a copy
becomes a revisit record without its payload, whose record ids, target and date are those of the response. Revisits that the archives
held already are resolved the same way, those whose original is nowhere stay as they are.

Of equal payloads (same SHA-1 and length) of at least ``least`` bytes the response is the record with the largest page id.

Defined cases: a null html is an empty payload, and empty payloads are equal; a null page id is smaller than all others and
comes back as null; of rows that share the largest id one is the response (by file and place); a null url is told by the id; a url's
control characters and blanks are written in percent form; an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, small_batches, spread, text_column

#: Compressed bytes after which a file is closed; a longer record still stays whole.
SEGMENT = 16 << 20
#: Bytes that the reader unpacks at a time.
WINDOW = 16 << 10
LEVEL = 1
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member of nothing.
LAST = gzip.compress(b"", mtime=0)
HEAD = "path string, at long, size long, type string, record_id string, refers_to string, page_id long, uri string, date string, digest string, payload_bytes long"
_NAMES = [x.split()[0] for x in HEAD.split(", ")]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: object) -> str:
    """A record id that depends on the parts alone, so a task that runs again writes the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, '|'.join(map(str, parts)))}>"


def record(fields: dict[str, str | None], http: str, payload: bytes) -> bytes:
    """One record as a gzip member; fields without a value are left out."""
    block = http.encode() + payload
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return gzip.compress(f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(place, size, content) of each gzip member that isn't empty."""
    at = 0
    while at < len(raw):
        unpack, end, out = zlib.decompressobj(31), at, []
        while not unpack.eof:
            piece = raw[end : end + WINDOW]
            if not piece:
                raise ValueError("an archive ends within a record")
            out.append(unpack.decompress(piece))
            end += len(piece)
        end -= len(unpack.unused_data)
        if content := b"".join(out):
            yield at, end - at, content
        at = end


def _fields(head: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]
    return {k.strip().lower().decode(): v.strip().decode() for k, v in (x.split(b":", 1) for x in lines if b":" in x)}


def parsed(content: bytes) -> tuple[dict[str, str], int, bytes]:
    """(fields, payload's length, payload) of a record; a revisit has the length of the payload that it stands for."""
    head, _, rest = content.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "revisit":
        return fields, int(_fields(http).get("content-length", 0)), b""
    if fields["warc-type"] == "response" and fields.get("warc-payload-digest") != f"sha1:{digest_of(payload)}":
        raise ValueError(f"the payload of {fields.get('warc-record-id')} isn't what its digest says")
    return fields, len(payload), payload


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """The headers of all records of the archives in ``folder``, with their places, and their payloads where asked for."""
    small_batches(spark)
    names = [*_NAMES, "payload"] if payload else _NAMES
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=False)))

    def row(path: str, at: int, size: int, content: bytes) -> tuple:
        f, n, body = parsed(content)
        page = f.get("x-page-id")
        digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
        return (path, at, size, f["warc-type"], f.get("warc-record-id"), f.get("warc-refers-to"), page and int(page), f.get("warc-target-uri"), f.get("warc-date"), digest, n, body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                done, held = [], 0
                for at, size, content in members(raw.as_py()):
                    done.append(row(path, at, size, content)[: len(names)])
                    held += len(content)
                    if len(done) == 4096 or payload and held > SEGMENT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
                        done, held = [], 0
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")
    return files.mapInArrow(run, f"{HEAD}, payload binary" if payload else HEAD)


def _archived(rows: DataFrame, make: Callable[..., bytes], folder: str) -> None:
    """Write ``make(part, number, *columns)`` of each row as a record into files of ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(make(part, number, *values))
                number, size = number + 1, size + len(held[-1])
                if size >= SEGMENT:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])

    files = rows.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    # the text writer puts down a value's bytes as they are, and the separator's after them
    writer = files.write.option("maxRecordsPerFile", 1).option("compression", "none").option("encoding", "ISO-8859-1")
    writer.option("lineSep", LAST.decode("latin-1")).text(folder)


def _http(size: int) -> str:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"


def _response(record: str, page: int | None, uri: str | None, date: str | None, digest: str) -> dict[str, str | None]:
    return {
        "WARC-Type": "response", "WARC-Record-ID": record, "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-Id": None if page is None else str(page), "Content-Type": "application/http; msgtype=response",
    }


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """A response record for each page, in the archives of ``folder``; ``date`` is when they were taken."""
    small_batches(pages.sparkSession)

    def make(part: int, number: int, page: int | None, uri: str | None, text: str) -> bytes:
        payload = text.encode()
        target = f"urn:page:{page}" if uri is None else re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", uri)
        return record(_response(record_id("page", part, number, page), page, target, date, digest_of(payload)), _http(len(payload)), payload)

    _archived(spread(pages.select(F.col(key).cast("long"), F.col(url).cast("string"), text_column(pages, html))), make, folder)


def originals(heads: DataFrame, least: int = 0) -> DataFrame:
    """(path, at, and the response's record, page, target and date) of each record that is to be a revisit."""
    rows = heads.where(F.col("type").isin("response", "revisit") & (F.col("payload_bytes") >= least))
    best = F.max(F.when(F.col("type") == "response", F.struct("page_id", "path", "at", "record_id", "uri", "date"))).alias("best")
    firsts = rows.groupBy("digest", "payload_bytes").agg(F.count("*").alias("n"), best).where("n > 1 and best is not null")
    copies = rows.select("digest", "payload_bytes", "path", "at").join(firsts.select("digest", "payload_bytes", "best"), ["digest", "payload_bytes"])
    return copies.where("path <> best.path or at <> best.at").select("path", "at", F.col("best.record_id").alias("to"), F.col("best.uri").alias("to_uri"), F.col("best.date").alias("to_date"))


def deduplicate(spark: SparkSession, source: str, folder: str, least: int = 0) -> None:
    """Write the archives of ``source`` into ``folder``, copies of a payload as revisits of one response."""
    revisits = materialise(originals(materialise(read(spark, source)), least))

    def make(part, number, type_, old, refers, page, uri, date, digest, n, payload, to, to_uri, to_date):
        fields = _response(record_id("copy", old), page, uri, date, digest)
        if type_ == "response" and to is None:
            return record(fields, _http(n), payload)
        if type_ in ("response", "revisit"):
            refers_to = refers if to is None else record_id("copy", to)
            fields |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": refers_to, "WARC-Refers-To-Target-URI": to_uri, "WARC-Refers-To-Date": to_date}
            return record(fields, _http(n), b"")
        return record(fields | {"WARC-Type": type_, "Content-Type": None, "WARC-Payload-Digest": None}, "", payload)

    rows = read(spark, source, payload=True).join(revisits, ["path", "at"], "left")
    _archived(rows.select("type", "record_id", "refers_to", "page_id", "uri", "date", "digest", "payload_bytes", "payload", "to", "to_uri", "to_date"), make, folder)


def resolved(heads: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records: a revisit has the page of the response that its header names."""
    columns = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type")]
    own = heads.where("type = 'response'")
    names = own.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("response"))
    others = heads.where("type = 'revisit'").join(names, "refers_to", "left").select(*columns, F.col("response").alias("refers_to"))
    return own.select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(others)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive all pages, deduplicate the archives and read those back."""
    spark = pages.sparkSession
    first, second = shared_dir(spark), shared_dir(spark)
    # an empty table writes no file; the reader wants a folder
    write(pages, first)
    deduplicate(spark, first, second, least)
    return resolved(materialise(read(spark, second)))
