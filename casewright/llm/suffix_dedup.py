"""Removal of repeated byte strings, with sorted suffixes built column by column for many documents at once.

A byte goes if a string of LENGTH bytes that covers it also starts earlier, in a document of smaller id or earlier in its own.

1. Every window of LENGTH bytes has an anchor, the gram in it with the least hash (the leftmost such). Equal windows have
   equal anchors at equal places, so only texts around equal anchors need comparing. A run of windows with one anchor is a
   segment; within an input partition, equal segments are reduced to the first.
2. Segments meet by their anchor's hash. Those whose content's hash or whose context of the anchor is another's ask for their bytes.
3. Segments of equal bytes repeat as a whole. Those that differ around an anchor are sorted together by column-wise
   construction: in each round one more symbol of every segment, from the last to the first, is inserted, and the collection's
   Burrows-Wheeler transform and the common prefixes of neighbours are brought up to date in one sequential pass. In the
   order of the suffixes, windows with a common prefix of LENGTH are equal, and all but the earliest repeat. A collection's
   segments are few, so its columns are arrays in memory; files aren't needed.
4. What repeats is cut out of the texts.

An anchor with many different segments is cut up before: windows that hold it at nearby places have more bytes around it in
common, and only those with equal such bytes can be equal. The places are halved until few segments are left together, at
last down to whole windows. Hashes decide what is compared; bytes alone decide what is equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH = 100
GRAM = 24
#: Segments in a collection; different ones of one anchor that may stay together.
COLLECTION = 4096
CROWD = 512
#: Places of an anchor in a window.
PLACES = LENGTH - GRAM + 1
#: Bytes that are hashed at a time, and segments that a task reduces at a time.
BLOCK_BYTES = 1 << 19
BLOCK_SEGMENTS = 400_000
#: Segments that are compared at a time.
COMPARED = 50_000
_PLACE = np.uint64((1 << 24) - 1)
_C = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]

SEGMENTS = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("content", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("contexts", T.LongType()), T.StructField("repeats", T.BooleanType())])
COMPARED_ROWS = T.StructType([*SEGMENTS.fields[:5], T.StructField("mixed", T.BooleanType())])
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
#: A window holds so many bytes to the left of its anchor or so many to the right of it.
CONTEXT = (LENGTH - GRAM) // 2


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    two = data[:-1].astype(np.uint16) | data[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
    n = len(data) - GRAM + 1
    h = eight[:n] * _C[0]
    h ^= h >> np.uint64(29)
    h += eight[8 : 8 + n] * _C[1]
    h *= _C[2]
    h ^= h >> np.uint64(31)
    h += eight[16 : 16 + n] * _C[3]
    h *= _C[4]
    h ^= h >> np.uint64(30)
    h *= _C[1]
    h ^= h >> np.uint64(32)
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def _contexts(hashes: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes, of 32 bits each, of the CONTEXT bytes left and right of anchors; 0 where the segment doesn't hold them."""

    def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        last = len(hashes) - 1
        both = hashes[np.clip(first, 0, last)] * _C[0] + hashes[np.clip(second, 0, last)]
        return (both >> np.uint64(32)) | np.uint64(1)

    left = np.where(place - CONTEXT >= start, joined(place - CONTEXT, place - GRAM), np.uint64(0))
    right = np.where(place + GRAM + CONTEXT <= end, joined(place + GRAM, place + CONTEXT), np.uint64(0))
    return left << np.uint64(32) | right


def segments(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after another in ``data``: (text, start in data, number of windows, anchor's hash, contexts) of each segment."""
    if len(data) < LENGTH:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2
    hashes = _gram_hashes(data)
    place = _least((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), LENGTH - GRAM + 1) & _PLACE
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - LENGTH + 1, 0))
    at = np.arange(len(owner)) + (begins - (np.cumsum(np.maximum(sizes - LENGTH + 1, 0)) - np.maximum(sizes - LENGTH + 1, 0)))[owner]
    anchor = place[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    owner, start, n, anchor = owner[first], at[first], np.diff(np.append(first, len(at))), anchor[first].astype(np.int64)
    return owner, start, n, hashes[anchor], _contexts(hashes, anchor, start, start + n + LENGTH - 1)


def _cut(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Segments of a partition's texts; of equal ones, all but the first are marked."""
    common.alone()
    held: list[tuple[np.ndarray, ...]] = []
    raws: list[bytes] = []
    n_held = 0

    def out() -> pa.RecordBatch:
        anchor, content, doc, start, n, contexts, raw, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, doc, content, anchor))
        anchor, content, doc, start, n, contexts, raw, place = (x[order] for x in (anchor, content, doc, start, n, contexts, raw, place))
        repeats = np.zeros(len(anchor), dtype=bool)
        repeats[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
        alike = np.flatnonzero(repeats)
        ends = place + n + LENGTH - 1
        sides = (x[k].tolist() for k in (alike - 1, alike) for x in (raw, place, ends))
        repeats[alike] = [raws[r][a:b] == raws[q][c:d] for r, a, b, q, c, d in zip(*sides, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((anchor, content, doc, start, n, contexts, repeats), _KINDS, strict=True)], names=SEGMENTS.names)

    def block(pieces: list[tuple[int, int, bytes]]) -> None:
        """pieces: document, place in it, bytes."""
        nonlocal n_held
        raw = b"".join([p[2] for p in pieces])
        sizes = np.array([len(p[2]) for p in pieces])
        owner, at, n, anchor, contexts = segments(np.frombuffer(raw, dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)
        view = memoryview(raw)
        content = np.array([xxhash.xxh3_64_intdigest(view[a : a + k]) for a, k in zip(at.tolist(), (n + LENGTH - 1).tolist(), strict=True)], dtype=np.uint64)
        docs, places, begins = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces]), np.cumsum(sizes) - sizes
        held.append((anchor.view(np.int64), content.view(np.int64), docs[owner], (at - begins[owner] + places[owner]).astype(np.int32), n.astype(np.int32), contexts.view(np.int64), np.full(len(n), len(raws), dtype=np.int32), at))
        raws.append(raw)
        n_held += len(n)

    pieces, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = (text or "").encode()
            # a very long text goes in pieces that share LENGTH - 1 bytes, so each window is in one
            for at in range(0, len(data), 8 * block_bytes) if len(data) >= LENGTH else ():
                piece = data[at : at + 8 * block_bytes + LENGTH - 1]
                if len(piece) < LENGTH:
                    continue
                pieces.append((doc, at, piece))
                size += len(piece)
                if size >= block_bytes:
                    block(pieces)
                    pieces, size = [], 0
        if n_held >= BLOCK_SEGMENTS:
            yield out()
            held, raws, n_held = [], [], 0
    if pieces:
        block(pieces)
    if held:
        yield out()


def _paired(anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Which rows share anchor and context with another; a context of 0 is none."""
    order = np.lexsort((context, anchor))
    a, c = anchor[order], context[order]
    same = (a[1:] == a[:-1]) & (c[1:] == c[:-1]) & (c[1:] != 0)
    found = np.zeros(len(a), dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted by anchor and content: those that may share a window with another, by the contents' hashes or, where an
    anchor has several contents, by the left or right context of the anchor (mixed). An anchor with more segments than are
    held at a time goes on whole."""

    def out(columns: tuple[np.ndarray, ...], kept: np.ndarray | slice = slice(None), mixed: np.ndarray | None = None) -> pa.RecordBatch:
        found = [pa.array(x[kept], kind) for x, kind in zip(columns[:5], _KINDS, strict=False)]
        return pa.RecordBatch.from_arrays([*found, pa.array(np.ones(len(found[0]), dtype=bool) if mixed is None else mixed[kept])], names=COMPARED_ROWS.names)

    def compared(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        anchor, content, _, _, _, contexts = columns
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]
        alike = ~new
        alike[:-1] |= alike[1:]
        firsts = np.flatnonzero(new)
        left, right = contexts[firsts].view(np.uint64) >> np.uint64(32), contexts[firsts].view(np.uint64) & np.uint64(0xFFFFFFFF)
        paired = _paired(anchor[firsts], left) | _paired(anchor[firsts], right)
        mixed = paired[np.cumsum(new) - 1]
        return out(columns, alike | mixed, mixed)

    held: list[tuple[np.ndarray, ...]] = []
    size, streaming = 0, None
    for batch in batches:
        columns = tuple(batch.column(k).to_numpy() for k in range(6))
        if streaming is not None and len(columns[0]):
            own = int(np.searchsorted(columns[0], streaming, "right"))
            if own:
                yield out(columns, slice(own))
            columns = tuple(x[own:] for x in columns)
            streaming = None if len(columns[0]) else streaming
        if not len(columns[0]):
            continue
        held.append(columns)
        size += len(columns[0])
        if size >= COMPARED:
            columns = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            begun = int(np.searchsorted(columns[0], columns[0][-1]))  # the last anchor may go on
            if begun:
                yield compared(tuple(x[:begun] for x in columns))
                held, size = [tuple(x[begun:] for x in columns)], size - begun
            else:
                yield out(columns)
                held, size, streaming = [], 0, columns[0][-1]
    if held:
        yield compared(tuple(np.concatenate(x) for x in zip(*held, strict=True)))


_LEVELS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8) - np.uint8(1)


def _least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values first ... last, for many such stretches, from the minima over runs of 1, 2, 4 ... values."""
    if not len(first):
        return values[:0]
    size = last - first + 1
    levels = np.where(size < 1 << 16, _LEVELS[np.minimum(size, (1 << 16) - 1)], np.frexp(size.astype(np.float64))[1] - 1).astype(np.int64)
    n, most = len(values), int(levels.max())
    table = np.empty((most + 1, n), dtype=values.dtype)
    table[0] = values
    for level in range(1, most + 1):
        half = 1 << level - 1
        np.minimum(table[level - 1, : n - 2 * half + 1], table[level - 1, half : n - half + 1], out=table[level, : n - 2 * half + 1])
    flat, at = table.ravel(), levels * n
    return np.minimum(flat[at + first], flat[at + last + 1 - (np.int64(1) << levels)])


def sorted_windows(texts: list[bytes], counts_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a collection in the order of its suffixes: (text, start, whether equal to the one before).

    Round t holds all suffixes of up to t symbols, in order, as the transform: the symbol before each. A suffix one symbol
    longer stands where its symbol's occurrences before it in the transform say, behind the empty suffixes; so each round
    inserts one symbol of every text, which is then that of its new suffix. Its common prefixes with its neighbours are one more
    than the least between their suffixes in the round before. Texts end at their right edge; a suffix that is a whole text has no
    symbol before it (0) and goes no further. Symbols are numbered from 1, so texts may hold any byte.
    """
    sizes = np.array([len(t) for t in texts])
    width, m = int(sizes.max()), len(texts)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    present = np.zeros(256, dtype=bool)
    present[raw] = True
    code = np.cumsum(present).astype(np.uint8 if present.sum() < 256 else np.uint16)
    # texts lie with their ends aligned, behind a column of no symbols
    stride = width + 1
    flat = np.zeros(m * stride, dtype=code.dtype)
    begins = np.cumsum(sizes) - sizes
    rows = np.repeat(np.arange(m), sizes)
    flat[np.arange(len(raw)) - begins[rows] + (stride - sizes)[rows] + rows * stride] = code[raw]
    edge = np.arange(1, m + 1, dtype=np.int32) * stride  # the empty suffixes
    left = edge - sizes.astype(np.int32)
    # the places before the suffixes, the symbols there, each one's common prefix with that before; and where the longest are
    places, before, prefixes = edge - 1, flat[edge - 1], np.zeros(m, dtype=np.uint8)
    longest = np.arange(m)
    for _ in range(width):
        n = len(places)
        own = np.argsort(before, kind="stable")
        counts = np.bincount(before, minlength=int(code[-1]) + 1)
        first = np.cumsum(counts) - counts
        longest = longest[before[longest] > 0]
        longest = longest[np.argsort(before[longest], kind="stable")]
        symbol = before[longest]
        at = np.empty(len(longest), dtype=np.int64)
        bounds = np.searchsorted(symbol, np.arange(len(counts) + 1))
        for c in np.flatnonzero(np.diff(bounds)).tolist():
            mine = slice(bounds[c], bounds[c + 1])
            at[mine] = first[c] + np.searchsorted(own[first[c] : first[c] + counts[c]], longest[mine])
        above = np.flatnonzero(at > first[symbol])
        below = np.flatnonzero(at + 1 < first[symbol] + counts[symbol])
        low = np.concatenate([own[at[above] - 1], longest[below]])
        high = np.concatenate([longest[above], own[at[below] + 1]])
        found = np.minimum(_least_between(prefixes, low + 1, high), LENGTH - 1) + np.uint8(1)
        new = m + at - counts[0]
        kept = np.ones(n + len(new), dtype=bool)
        kept[new] = False
        moved = places[longest] - 1
        grown = [np.empty(n + len(new), dtype=x.dtype) for x in (places, before, prefixes)]
        for to, old, added in zip(grown, (places, before, prefixes), (moved, flat[moved], np.uint8(0)), strict=True):
            to[kept] = old
            to[new] = added
        places, before, prefixes = grown
        prefixes[new[above]] = found[: len(above)]
        prefixes[new[below] + 1] = found[len(above) :]
        longest = new
    suffixes = places + 1
    text = (suffixes - 1) // stride
    start = suffixes - left[text]
    group = np.cumsum(prefixes < LENGTH)
    real = np.flatnonzero((start >= 0) & (start < counts_of[text]) & (suffixes < edge[text]))
    group = group[real]
    equal = np.zeros(len(real), dtype=bool)
    equal[1:] = group[1:] == group[:-1]
    return text[real], start[real], equal


FOUND = T.StructType([T.StructField("doc", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())])


def repeated_windows(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """Of segments (document, start, number of windows, bytes): runs of windows that repeat an earlier one of the collection."""
    docs, starts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    text, at, equal = sorted_windows([r[3] for r in rows], np.array([r[2] for r in rows]))
    group = np.cumsum(~equal)
    doc, place = docs[text], starts[text] + at
    order = np.lexsort((place, doc, group))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = group[order][1:] == group[order][:-1]
    doc, place = doc[order][again], place[order][again]
    if not len(doc):
        return []
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    return list(zip(doc[first].tolist(), place[first].tolist(), np.diff(np.append(first, len(doc))).tolist(), strict=True))


FETCHED = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("content", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()), T.StructField("repeats", T.BooleanType())])
_FETCHED = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]


def _collect(batches: Iterator[pa.RecordBatch], collection: int) -> Iterator[pa.RecordBatch]:
    """Of segments (anchor, content, doc, start, n, data, mixed) sorted by the first four: those of equal bytes repeat the first; those
    that differ and are mixed go by whole anchors, several to a collection."""

    def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True) if found else [[]] * 3, [pa.int64(), pa.int32(), pa.int32()], strict=True)], names=FOUND.names)

    rows: list[tuple] = []
    own: list[tuple] = []
    whole: list[tuple[int, int, int]] = []
    alike: set[bytes] = set()
    at = of = None
    for batch in batches:
        for anchor, content, doc, start, n, data, mixed in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if anchor != at:
                if len(own) > 1:
                    if len(rows) + len(own) > collection and rows:
                        yield out(repeated_windows(rows))
                        rows = []
                    rows += own
                own, at, of = [], anchor, None
            if content != of:
                alike, of = set(), content
            if data in alike:
                whole.append((doc, start, n))
            else:
                alike.add(data)
                if mixed:
                    own.append((doc, start, n, data))
        if whole:
            yield out(whole)
            whole = []
    if len(own) > 1:
        rows += own
    if rows:
        yield out(repeated_windows(rows))


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of crowded anchors, cut by the places at which their windows hold the anchor: of each half of the places the windows,
    under a key of what bytes around the anchor these have in common. Of equal ones in a task, all but the first are marked."""
    held: dict[tuple[int, bytes], list[tuple[int, int, int, int, int]]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        made = []
        for (key, data), rows in held.items():
            rows.sort()
            content = xxhash.xxh3_64_intdigest(data)
            content -= (content >> 63) << 64
            made += [(key, content, doc, start, n, data if k == 0 else None, low, high, k > 0) for k, (doc, start, n, low, high) in enumerate(rows)]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*made, strict=True), _FETCHED, strict=True)], names=FETCHED.names)

    for batch in batches:
        for _, _, doc, start, n, data, low, high in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            # the anchor is the least gram of those that all windows hold
            shared = _gram_hashes(np.frombuffer(data, dtype=np.uint8)[n - 1 : LENGTH])
            anchor = n - 1 + int(((shared & ~_PLACE) | np.arange(len(shared), dtype=np.uint64)).argmin())
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle, high)) if high - low > 1 else ((low, high),):
                # window j holds the anchor at place anchor - j
                first, last = max(0, anchor - b + 1), min(n, anchor - a + 1)
                if first >= last:
                    continue
                # places a ... b - 1: at least a bytes before the anchor, and PLACES - b after it
                key = xxhash.xxh3_64_intdigest(data[anchor - a : anchor + GRAM + PLACES - b] + bytes([a, b]))
                held.setdefault((key - ((key >> 63) << 64), data[first : last + LENGTH - 1]), []).append((doc, start + first, last - first, a, b))
                size += 1
        if size >= COMPARED:
            yield out()
            held, size = {}, 0
    if held:
        yield out()


def repeats(docs: DataFrame, id_col: str, text_col: str, collection: int = COLLECTION, block_bytes: int = BLOCK_BYTES, crowd: int = CROWD) -> DataFrame:
    """(doc, start, n): runs of starts of windows that also start earlier. Ids must be distinct and not null."""
    spark = docs.sparkSession
    common.prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    cut = texts.mapInArrow(partial(_cut, block_bytes=block_bytes), SEGMENTS)
    found = common.materialise(cut, "suffix-segments")
    result = found.filter("repeats").select("doc", "start", "n")
    dealt = found.filter("not repeats").repartition(parts, "anchor").sortWithinPartitions("anchor", "content")
    compared = common.materialise(dealt.drop("repeats").mapInArrow(_compare, COMPARED_ROWS), "suffix-compared")
    by_doc = compared.groupBy("doc").agg(F.collect_list(F.struct("anchor", "content", "start", "n", "mixed")).alias("segments"))
    fetched = texts.join(by_doc, "doc").select("doc", F.encode("text", "utf-8").alias("data"), F.explode("segments").alias("s"))
    fetched = fetched.select(F.col("s.anchor").alias("anchor"), F.col("s.content").alias("content"), "doc", F.col("s.start").alias("start"), F.col("s.n").alias("n"), F.expr(f"substring(data, s.start + 1, s.n + {LENGTH - 1})").alias("data"), F.col("s.mixed").alias("mixed"))
    columns = FETCHED.names[:6]

    def crowded(rows: DataFrame) -> DataFrame:
        """Anchors with more than ``crowd`` different contents, of rows with these two."""
        kinds = rows.groupBy("anchor", "content").agg(F.lit(1).alias("one")).groupBy("anchor").agg(F.count("one").alias("kinds"))
        return common.materialise(kinds.filter(F.col("kinds") > crowd).select("anchor"), "suffix-crowded")

    def collected(rows: DataFrame) -> DataFrame:
        order = rows.select(*columns, "mixed").repartition(parts, "anchor").sortWithinPartitions("anchor", "content", "doc", "start")
        return common.materialise(order.mapInArrow(partial(_collect, collection=collection), FOUND), "suffix-found")

    many = crowded(compared.filter("mixed"))
    if many.isEmpty():
        return result.unionAll(collected(fetched))
    fetched = common.materialise(fetched, "suffix-fetched")
    # of crowded anchors, what isn't mixed is only compared whole
    few = fetched.join(many.withColumn("crowded", F.lit(True)), "anchor", "left")
    result = result.unionAll(collected(few.filter("crowded is null or not mixed")))
    rows, width = few.filter("crowded and mixed").select(*columns, F.lit(0).alias("low"), F.lit(PLACES).alias("high")), PLACES
    while True:
        made = common.materialise(rows.mapInArrow(_halves, FETCHED), "suffix-halves")
        width = (width + 1) // 2
        result = result.unionAll(made.filter("repeats").select("doc", "start", "n"))
        rows = made.filter("not repeats").drop("repeats").withColumn("mixed", F.lit(True))
        many = crowded(rows) if width > 1 else None
        if many is None or many.isEmpty():
            return result.unionAll(collected(rows))
        result = result.unionAll(collected(rows.join(many, "anchor", "left_anti")))
        rows = rows.join(many, "anchor", "left_semi")


def cut_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", collection: int = COLLECTION, block_bytes: int = BLOCK_BYTES, crowd: int = CROWD) -> DataFrame:
    """Add n_bytes, spans (array of [begin, end) of removed bytes) and kept (the bytes that remain) to every row.

    Null texts are empty. Texts under LENGTH bytes are never cut. Of rows that repeat an id, the order is that of their
    texts' hashes; null ids come first. Ids must be integers. Columns named like the added ones are replaced,
    others pass through; an empty table stays empty.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select(*[c for c in docs.columns if c not in ("n_bytes", "spans", "kept", "_doc") or c in (id_col, text_col)])
    keyed = common.keyed(docs, id_col, text_col)
    by_doc = repeats(keyed, "_doc", text_col, collection, block_bytes, crowd).groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("start", "n")).alias("_runs"))
    joined = keyed.join(by_doc, "_doc", "left").drop("_doc")
    at = joined.columns.index(text_col)
    names = [c for c in joined.columns if c != "_runs"]
    schema = T.StructType([*[joined.schema[c] for c in names], T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType(), False), False)), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, runs in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                data = (text or "").encode()
                own, parts, last = merged(runs or []), [], 0
                for a, b in own:
                    parts.append(data[last:a])
                    last = b
                sizes.append(len(data))
                spans.append(own)
                kept.append(b"".join([*parts, data[last:]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names=schema.names)

    return joined.select(*names, "_runs").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated strings cut out of the texts; characters that a cut leaves in part go too.

    Rows of which nothing remains are left out; rows without a cut, null and empty texts among them, stay as they were.
    """
    found = cut_out(common.pack(docs, id_col, text_col))
    # a byte that goes on a character, at the head of what remains after a cut, or a character that breaks off before one
    whole = F.udf(lambda data: bytes(data).decode("utf-8", "ignore"), "string", useArrow=True)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(whole("kept"))
    return common.unpack(found.filter("size(spans) = 0 or octet_length(kept) > 0").withColumn("text", text), docs, id_col, text_col)


def merged(runs: list[dict]) -> list[list[int]]:
    """Maximal spans of bytes that the windows of these runs cover."""
    out: list[list[int]] = []
    for a, n in sorted((r["start"], r["n"]) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n + LENGTH - 1)
        else:
            out.append([a, a + n + LENGTH - 1])
    return out


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digests after its repeated strings are cut out."""
    return digests(cut_out(common.read(spark, sf_dir, "documents").select("doc_id", "text")))
