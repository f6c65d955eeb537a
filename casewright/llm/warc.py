"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; a bundle ends with a seek table, a skippable frame that
lists the compressed and the plain size of each frame. The index maps a record's identifier to its bundle, its frame and
its place within the frame, so one record is read by decompressing one frame.

Payloads that repeat are stored once: the row with the largest id is the response, the others revisit it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Payloads shorter than this aren't made revisits.
MIN_SHARED = 1000
FRAME_BYTES = 256_000
#: A bundle is closed once it has this many compressed bytes, so that a whole bundle can be read by one task.
BUNDLE_BYTES = 16_000_000
LEVEL = 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"
INDEX = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("bundle", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("frame_at", T.LongType()), T.StructField("record_at", T.LongType()), T.StructField("record_bytes", T.LongType())])
RECORDS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])


def record_id(page: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page}')}"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (``refers_to`` set) leaves the payload out and names its size and the response's record."""
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        f"WARC-Record-ID: <{record_id(page)}>".encode(),
        f"WARC-Date: {DATE}".encode(),
        b"WARC-Target-URI: " + " ".join((url or "").split()).encode(),
        f"WARC-Payload-Digest: sha1:{digest}".encode(),
        f"X-Page-ID: {'' if page is None else page}".encode(),
        f"X-Payload-Length: {len(payload)}".encode(),
    ]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>".encode(), f"X-Refers-To-Page-ID: {refers_to}".encode()]
        payload = b""
    head += [b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        at = end + 8 + size


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame at a bundle's end: a pair of sizes for each frame, their number, flags, the seekable format's magic."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from a bundle's last bytes."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    sizes = struct.iter_unpack("<II", tail[len(tail) - 9 - 8 * n : len(tail) - 9])
    out, at = [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


class Bundles:
    """Writes a task's bundles. A file's name holds the attempt, and only the files of the attempt that ends well are listed."""

    def __init__(self, folder: str, task: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES):
        from pyarrow import fs
        from zstandard import ZstdCompressor

        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.task, self.packer, self.number = task, ZstdCompressor(level=LEVEL), 0
        self.parts: list[bytes] = []
        self.frames: list[tuple[int, int]] = []
        self.plain = bytearray()
        self.at = 0
        self.waiting: list[tuple[str, int, int]] = []
        self.index: list[tuple] = []

    @property
    def name(self) -> str:
        return f"{self.task}-{self.number:05d}.warc.zst"

    def add(self, key: str, data: bytes) -> None:
        self.waiting.append((key, len(self.plain), len(data)))
        self.plain += data
        if len(self.plain) >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        packed = self.packer.compress(bytes(self.plain))
        self.index += [(key, self.name, len(self.frames), self.at, begin, size) for key, begin, size in self.waiting]
        self.frames.append((len(packed), len(self.plain)))
        self.parts.append(packed)
        self.at += len(packed)
        self.plain, self.waiting = bytearray(), []
        if self.at >= self.bundle_bytes:
            self.close()

    def close(self) -> None:
        if self.waiting:
            self.end_frame()
        if self.parts:
            with self.store.open_output_stream(f"{self.root}/{self.name}", compression=None) as f:
                f.write(b"".join([*self.parts, seek_table(self.frames)]))
            self.parts, self.frames, self.at = [], [], 0
            self.number += 1


def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_shared: int = MIN_SHARED) -> DataFrame:
    """Add payload_bytes, payload_digest (SHA-1, hex) and refers_to (the response's id, null for responses).

    Payloads are told apart by SHA-256 and length. A null payload is empty. Rows that repeat the response's id are responses too.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.withColumn("payload_bytes", F.octet_length(payload).cast("bigint")).withColumn("payload_digest", F.sha1(payload)).withColumn("_key", F.when(F.col("payload_bytes") >= min_shared, F.sha2(payload, 256)))
    shared = pages.select(F.col(id_col), F.when(F.octet_length(payload) >= min_shared, F.sha2(payload, 256)).alias("_key")).filter("_key is not null")
    shared = common.materialise(shared.groupBy("_key").agg(F.max(id_col).alias("_response"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "payloads")
    total = pages.count()
    # payloads without a copy carry no key into the join, but are dealt out by id
    found = common.attach(rows.withColumn("_key", F.coalesce("_key", F.concat(F.lit("-"), F.xxhash64(id_col).cast("string")))), shared, "_key", "_n", total, id_col)
    return found.withColumn("refers_to", F.when(F.col(id_col) < F.col("_response"), F.col("_response"))).drop("_key", "_response", "_n")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record for each row into bundles in ``folder`` (a URI all executors share); returns the index, written there too.

    Null texts are empty payloads, null urls empty; ids may be null or repeat (their records then share an identifier).
    Very long payloads get a frame of their own size. An empty table gives no bundle. Other columns aren't written.
    """
    common.prepare(pages.sparkSession, rows=500)
    rows = with_revisits(pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "page_id", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, bundles = TaskContext.get(), None
        for batch in batches:
            bundles = bundles or Bundles(folder, f"{context.partitionId():06d}-{context.taskAttemptId()}", frame_bytes, bundle_bytes)
            for page, url, html, digest, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                bundles.add(record_id(page), record(page, url, (html or "").encode(), digest, refers_to))
        if bundles:
            bundles.close()
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*bundles.index, strict=True), [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=INDEX.names)

    index = rows.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the bundles that the index in ``folder`` lists. Each response's digest and length are computed anew and must agree."""
    common.prepare(spark)
    listed = spark.read.schema(INDEX).parquet(f"{folder}/index").select("bundle").distinct()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        unpacker = ZstdDecompressor()
        for batch in batches:
            for value in batch.column(0):
                content = memoryview(value.as_buffer())
                for at, packed, plain in read_seek_table(content):
                    rows = [_row(h, block, payloads) for h, block in parse(unpacker.decompress(content[at : at + packed], max_output_size=plain))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=True)], names=RECORDS.names)

    return files.join(listed, "bundle", "left_semi").select("content").mapInArrow(run, RECORDS)


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha1(block).hexdigest() != digest or len(block) != size):
        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
    number = lambda x: int(x) if x else None
    return number(headers["X-Page-ID"]), headers["WARC-Target-URI"], size, digest, headers["WARC-Type"], number(headers.get("X-Refers-To-Page-ID")), block if payloads and not revisit else None


def fetch(folder: str, entry: dict) -> tuple[dict[str, str], bytes]:
    """One record by its row of the index, from its frame alone."""
    from pyarrow import fs
    from zstandard import ZstdDecompressor

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{entry['bundle']}") as f:
        size = f.size()
        n = struct.unpack("<I", f.read_at(9, size - 9)[:4])[0]
        at, packed, plain = read_seek_table(f.read_at(9 + 8 * n, size - 9 - 8 * n))[entry["frame"]]
        data = ZstdDecompressor().decompress(f.read_at(packed, at), max_output_size=plain)
    return next(parse(data[entry["record_at"] : entry["record_at"] + entry["record_bytes"]]))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives."""
    folder = common.run_dir(spark, "warc")
    write(common.read(spark, sf_dir, "pages"), folder)
    return read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS response FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM m
"""
