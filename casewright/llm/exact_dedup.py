"""Exact deduplication by Grace hashing.

Texts are equal if they are identical without white space. Their normalised content is partitioned by hash into spill files
(a shuffle's files, which Spark keeps and recovers), and each partition is read against an open-addressing table of bounded
size that compares complete content. What doesn't fit a full table is spilled again and partitioned by the next hash,
until everything has found its place.

Before the first shuffle, each input partition goes through such a table as well: of a text with many copies, only one record
for each input partition travels. The classes are then brought back to the rows by ``common.attach``, which bears hot classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of content that one table holds.
TABLE_BYTES = 96_000_000
#: What an entry costs besides its content.
ENTRY_BYTES = 200
#: Bytes of output that a task gathers before it passes them on.
OUT_BYTES = 8_000_000


class Table:
    """An open-addressing hash table from complete contents to (best length, best id, rows, rows like the best)."""

    def __init__(self, limit: int):
        self.limit, self.bytes = limit, 0
        self.slots = np.full(1 << 12, -1, dtype=np.int32)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.best: list[tuple[int, int]] = []
        self.rows: list[int] = []
        self.alike: list[int] = []

    def _probe(self, h: int, content: bytes) -> int:
        """The slot that holds the content, or the free one where it belongs."""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0 and not (self.hashes[k] == h and self.contents[k] == content):
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int32)
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k

    def put(self, h: int, content: bytes, length: int, doc: int | None, rows: int, alike: int) -> bool:
        """False if the content is new and the table is full."""
        at = self._probe(h, content)
        key = (-length, doc is None, doc or 0)
        if (k := self.slots[at]) >= 0:
            self.rows[k] += rows
            if key < self.best[k]:
                self.best[k], self.alike[k] = key, alike
            elif key == self.best[k]:
                self.alike[k] += alike
            return True
        if self.contents and self.bytes + len(content) > self.limit:
            return False
        self.slots[at] = len(self.contents)
        self.bytes += len(content) + ENTRY_BYTES
        self.hashes.append(h)
        self.contents.append(content)
        self.best.append(key)
        self.rows.append(rows)
        self.alike.append(alike)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return True

    def records(self) -> Iterator[tuple]:
        for content, (length, missing, doc), rows, alike in zip(self.contents, self.best, self.rows, self.alike, strict=True):
            yield content, -length, None if missing else doc, rows, alike


RECORDS = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("length", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("n_rows", T.LongType()), T.StructField("alike", T.LongType()), T.StructField("sha", T.StringType())])


def normalised(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"[{common.SPACE_CLASS}]+", "")


def _batches(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    ready, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*ready, strict=True), [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=RECORDS.names)

    for record in records:
        ready.append(record)
        size += len(record[0] or b"") + 100
        if size >= OUT_BYTES:
            yield out()
            ready, size = [], 0
    if ready:
        yield out()


def _gather(batches: Iterator[pa.RecordBatch], table_bytes: int) -> Iterator[pa.RecordBatch]:
    """Within an input partition: one record for each content, as far as the table holds them; a full table is passed on and begun anew."""

    common.alone()

    def records() -> Iterator[tuple]:
        table = Table(table_bytes)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                content = text.encode().translate(None, common.SPACES)
                h = xxhash.xxh3_64_intdigest(content)
                if not table.put(h, content, len(text), doc, 1, 1):
                    yield from ((*r, None) for r in table.records())
                    table = Table(table_bytes)
                    table.put(h, content, len(text), doc, 1, 1)
        yield from ((*r, None) for r in table.records())

    return _batches(records())


def _settle(batches: Iterator[pa.RecordBatch], table_bytes: int) -> Iterator[pa.RecordBatch]:
    """Within a hash partition: classes (content null, sha set), and records for which there was no room (content set)."""

    def records() -> Iterator[tuple]:
        table = Table(table_bytes)
        for batch in batches:
            for content, length, doc, rows, alike in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if not table.put(xxhash.xxh3_64_intdigest(content), content, length, doc, rows, alike):
                    yield content, length, doc, rows, alike, None
        for content, length, doc, rows, alike in table.records():
            yield None, length, doc, rows, alike, hashlib.sha256(content).hexdigest()

    return _batches(records())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct normalised text: sha, keep_id, n_rows, alike (rows with the keep_id and its length)."""
    spark = docs.sparkSession
    common.prepare(spark)
    records = docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(partial(_gather, table_bytes=table_bytes), RECORDS)
    settled, level, parts = None, 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        dealt = records.repartition(parts, F.xxhash64("content", F.lit(level)))
        done = common.materialise(dealt.mapInArrow(partial(_settle, table_bytes=table_bytes), RECORDS), "exact-dedup")
        found = done.filter(F.col("content").isNull())
        settled = found if settled is None else settled.unionAll(found)
        records = done.filter(F.col("content").isNotNull())
        # every table takes a content at least, so levels come to an end; empty contents count as rows
        n_left, left = records.agg(F.count(F.lit(1)), F.sum(F.octet_length("content") + ENTRY_BYTES)).first()
        if not n_left:
            break
        level += 1
        parts = max(parts, int(left // (table_bytes // 2 + 1)) + 1)
    return settled.select("sha", F.col("doc").alias("keep_id"), "n_rows", "alike")


ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Add keep_id, group_size, kept and text_sha256 to every row.

    Of the rows whose texts are equal without the characters of ``[\\x20\\x09-\\x0D]``, the one with the most code points in
    its original text stays, then the smallest id. Null texts count as empty, so null, empty and blank texts are one
    group. A null id sorts after all others. Rows that repeat the kept row's id and length are all marked as
    kept here (``keep_one`` then leaves one). Texts of any length are compared whole. An empty table stays empty.
    Other columns pass through; those named like the four added ones are replaced. Ids must be integers.
    """
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED or c in (id_col, text_col)])
    packed = common.pack(own, id_col, text_col)
    marked = _marked(packed, classes(packed, table_bytes=table_bytes), "doc_id", "text")
    named = {id_col: "doc_id", text_col: "text"}
    return marked.select(*[F.col(named[c] if c in named else f"rest.`{c}`").alias(c) for c in own.columns], *ADDED)


def _marked(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    total = found.agg(F.sum("n_rows")).first()[0] or 0
    rows = docs.withColumn("text_sha256", F.sha2(F.encode(normalised(text_col), "utf-8"), 256))
    joined = common.attach(rows, found.select(F.col("sha").alias("text_sha256"), "keep_id", F.col("n_rows").alias("group_size"), "alike"), "text_sha256", "group_size", total, id_col)
    return joined.withColumn("kept", F.col(id_col).cast("bigint").eqNullSafe(F.col("keep_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each group, with the columns of ``docs``.

    Of rows that repeat the kept row's id, one of those with the longest text stays.
    """
    packed = common.pack(docs, id_col, text_col)
    found = classes(packed)
    marked = _marked(packed, found, "doc_id", "text").withColumn("_length", F.length(F.coalesce(F.col("text"), F.lit(""))))
    marked = marked.filter("kept")
    if not found.filter("alike > 1").isEmpty():
        # some classes hold rows that agree in id and length: of these few classes' kept rows, one each
        first = marked.filter("alike > 1").groupBy("text_sha256").agg(F.max_by(F.struct(*packed.columns), "_length").alias("row")).select("row.*")
        marked = marked.filter("alike = 1").select(*packed.columns).unionByName(first)
    return common.unpack(marked, docs, id_col, text_col)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
