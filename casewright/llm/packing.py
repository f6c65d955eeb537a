"""Packing: documents as token sequences of a fixed length with little padding, by minimum bin slack.

A document's ids are cut into full windows; what remains of it is one piece, shorter than a window. The pieces of many
documents are then packed window by window: the longest piece is set, and a subset-sum dynamic programme over a bitset
finds the multiset of the other remaining lengths (each length with its count) that comes closest to the window's
capacity; the counts are found by going back through the bitsets. A piece is cut only where no multiset fills a window.

Packing is local to a partition of the input and streams through it: nothing is shuffled, no group of documents is
collected, and memory holds the ids of about ``pending_tokens`` tokens. Every task can be run again alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

WINDOW = 4096
END_ID = 2
PENDING_TOKENS = 4_000_000


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset of lengths, as (length, count), whose sum comes closest to ``capacity`` from below.

    Bit s of ``reach`` says that some multiset sums to s. A length with count c enters as chunks of 1, 2, 4, ... pieces,
    so that each chunk is taken or not; the bitset before each chunk is kept for the way back.
    """
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, chunk = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            chunk *= 2
        if reach >> capacity:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return list(chosen.items())


class Packer:
    """Takes documents' ids, gives pieces (document, start, ids, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.heap: dict[int, list[tuple]] = {}
        self.pending = 0

    def _hold(self, piece: tuple) -> None:
        self.heap.setdefault(len(piece[2]) // 4, []).append(piece)
        self.pending += len(piece[2]) // 4

    def _take(self, length: int) -> tuple:
        stack = self.heap[length]
        piece = stack.pop()
        if not stack:
            del self.heap[length]
        self.pending -= length
        return piece

    def add(self, doc: tuple, ids: bytes) -> Iterator[tuple]:
        """doc: what is repeated in each of the document's pieces."""
        step = 4 * self.window
        for at in range(0, len(ids), step):
            part = ids[at : at + step]
            if len(part) == step:
                yield (*doc, at // 4, part, self.sequence, 0)
                self.sequence += 1
            else:
                self._hold((doc, at // 4, part))

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, part in pieces:
            yield (*doc, start, part, self.sequence, offset)
            offset += len(part) // 4
        self.sequence += 1

    def drain(self, last: bool = False) -> Iterator[tuple]:
        """Pack what is pending into full windows; what doesn't fill one waits for more, or, if ``last``, is cut at powers of two."""
        while self.pending >= self.window:
            longest = max(self.heap)
            pieces = [self._take(longest)]
            room = self.window - longest
            if room:
                for length, n in fill({k: len(v) for k, v in self.heap.items() if k <= room}, room):
                    pieces += [self._take(length) for _ in range(n)]
                    room -= length * n
            if room:  # all that is left is longer than the room, or sums to less: cut the longest
                doc, start, part = self._take(max(self.heap))
                pieces.append((doc, start, part[: 4 * room]))
                self._hold((doc, start + room, part[4 * room :]))
            yield from self._close(pieces)
        if last and self.pending:
            rest = [self._take(length) for length in sorted(self.heap, reverse=True) for _ in range(len(self.heap[length]))]
            size = sum(len(part) // 4 for _, _, part in rest)
            for bit in reversed(range(size.bit_length())):
                need, pieces = size & 1 << bit, []
                while need:
                    doc, start, part = rest.pop()
                    if len(part) > 4 * need:
                        rest.append((doc, start + need, part[4 * need :]))
                        part = part[: 4 * need]
                    need -= len(part) // 4
                    pieces.append((doc, start, part))
                if pieces:
                    yield from self._close(pieces)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, pending_tokens: int = PENDING_TOKENS) -> DataFrame:
    """Pieces of all documents: ``id_col``, start, ids (little-endian uint32 bytes), doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's, without special tokens, then ``end_id``. Each id lies in one piece. All
    sequences have ``window`` ids, but for at most log2(window) of each partition, whose sizes are powers of two; so no
    sequence needs padding, where sizes of powers of two need none.

    Null and empty texts give the end id alone. Very long texts give full windows as they come. Repeated rows and
    repeated or null ids are documents of their own. Columns besides the two named are left out, whatever their names.
    An empty table gives no pieces. ``window`` must be a power of two or sizes below it are padded by the reader.
    """
    common.prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common.alone("tokens")
        encoder = tokens.word_encoder(tokenizer_path)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        ready: list[tuple] = []
        size = 0

        def out(kind: pa.DataType) -> pa.RecordBatch:
            ids, docs_tokens, starts, parts, sequences, offsets = zip(*ready, strict=True) if ready else [()] * 6
            longs = [pa.array(x, pa.int64()) for x in (starts, docs_tokens, sequences, offsets)]
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), longs[0], pa.array(parts, pa.binary()), *longs[1:]], names=schema.names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                ready += packer.add((doc, len(ids) // 4), ids)
                size += len(ids)
                if packer.pending >= pending_tokens:
                    ready += packer.drain()
                if size >= 4 * pending_tokens:
                    yield out(kind)
                    ready, size = [], 0
        ready += packer.drain(last=True)
        if ready:
            yield out(kind)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its place in its sequence."""
    pieces = pack(common.read(spark, sf_dir, "documents"), tokens.vocabulary_path("word_bpe_49k.json"))
    length = F.expr("cast(octet_length(ids) / 4 as bigint)")
    return pieces.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
