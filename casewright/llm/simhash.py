"""SimHash near-duplicate detection by deletion-variant signatures.

Two fingerprints that differ in at most k bits agree, but for at most one bit, on one of k // 2 + 1 segments: k bits can't be
two or more in each. So a fingerprint is cut into that few segments, and for each segment and each of its bits a signature is
indexed that leaves the bit out. Fingerprints with a signature in common meet in an equality join and are verified. A pair
meets under many signatures (all of a segment in which both agree), but is taken up under one only: the first segment
that differs by at most one bit, without the bit that differs, or without the first bit.

Rows with equal fingerprints are one class, and links are sought between classes. A class has a bounded number of linked
classes (the fingerprints within k bits), whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHINGLE = 3
DISTANCE = 2
SEED = 42
BITS = 64
#: Signatures with more classes than this are refined, by the same cut of the bits outside the segment.
DENSE = 500
#: Near copies: words in a shingle, the agreement of shingles asked for, differing bits up to which signatures' rows are put to the test.
NEAR_SHINGLE = 5
NEAR_LEAST = 0.8
NEAR_BITS = 8
#: Segments of the near copies' fingerprint: up to three differing bits are always found here.
NEAR_SEGMENTS = 2
#: Buckets up to this size give all links, larger ones connecting links; a bucket of more than a block is dealt out.
SMALL_BUCKET = 16
BLOCK = 16_384
HELD_ROWS = 500_000
LABEL_ROWS = 10_000
#: The exact index puts rare shingles first: one document in so many is counted, and a shingle in so many of these is not rare.
#: At most so many are told apart. These numbers change what the index costs, not what it finds.
COUNTED_DOCS = 8
COUNTED_LEAST = 4
COUNTED_SHINGLES = 1_000_000
BROADCAST_KEYS = 100_000
#: Shingles of the exact index with more rows than this are hot: their rows meet in cells of two blocks, of so many rows and
#: bytes of text at most by the hash's lot. Shingles counted so often are known to be hot before they are dealt.
HOT_ROWS = 64
CELL_ROWS = 2048
CELL_BYTES = 8_000_000
COUNTED_HOT = 200
HELD_WORDS = 300_000
HELD_SHINGLES = 2_000_000
#: Shingles whose bits are counted at a time.
COUNTED_AT_ONCE = 1 << 16
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text: a bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    hashed = b"".join([xxhash.xxh64_digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)] or [xxhash.xxh64_digest(line, SEED)])
    return int.from_bytes(_majority(hashed), "big", signed=True)


def _majority(hashed: bytes) -> bytes:
    """Of hashes of eight bytes, one after another: the bits set in over half."""
    rows = np.frombuffer(hashed, dtype=np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(rows), COUNTED_AT_ONCE):
        lanes = _LANES[rows[at : at + COUNTED_AT_ONCE]]
        # eight counters of a byte each in a word; sums of up to 255 don't overflow
        counts += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(rows)).tobytes()


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, out_col: str = "fp") -> DataFrame:
    """Add the whole text's fingerprint as a long (the same bits, signed) and leave the text out."""
    common.prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text_col, out_col)]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, pa.int64())], names=schema.names)

    return docs.select(*kept, text_col).mapInArrow(run, schema)


def segments(bits: list[int], distance: int) -> list[list[int]]:
    """The bits, cut into distance // 2 + 1 segments of about one length."""
    n = distance // 2 + 1
    return [bits[k * len(bits) // n : (k + 1) * len(bits) // n] for k in range(n)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _signatures(bits: list[int], distance: int) -> Column:
    """Array of (segment, left-out bit, segment's value without it) for a fingerprint."""
    found = []
    for k, segment in enumerate(segments(bits, distance)):
        for b in segment:
            found.append(F.struct(F.lit(k * BITS + b).alias("place"), F.col("fp").bitwiseAND(F.lit(_mask([x for x in segment if x != b]))).alias("value")))
    return F.array(*found)


def _first(difference: Column, bits: list[int], distance: int) -> Column:
    """The place under which a pair with these differing bits is taken up; null if none."""
    place = F.lit(None).cast("int")
    for k, segment in reversed(list(enumerate(segments(bits, distance)))):
        own = difference.bitwiseAND(F.lit(_mask(segment)))
        at = F.when(own == 0, F.lit(segment[0]))
        for b in segment:
            at = at.when(own == F.lit(_mask([b])), F.lit(b))
        place = F.coalesce(F.lit(k * BITS) + at, place)
    return place


def links(fps: DataFrame, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints, of a table with one row for each in ``fp``, that differ in at most ``distance`` bits."""
    every = list(range(BITS))
    # the table may lie in few files; its signatures are many
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    signed = fps.select("fp", F.explode(_signatures(every, distance)).alias("s")).select("fp", "s.place", "s.value")
    met = signed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("value", "place"))).filter("n > 1")
    met = common.materialise(met, "simhash-signatures")
    found = _meet(met.filter(F.col("n") <= dense), ["place", "value"], every, distance)
    if not met.filter(F.col("n") > dense).isEmpty():
        # a dense signature's members agree in all but a bit of a segment: their other bits are cut and indexed in turn
        crowded = met.filter(F.col("n") > dense)
        for k, segment in enumerate(segments(every, distance)):
            rest = [b for b in every if b not in set(segment)]
            own = crowded.filter(F.floor(F.col("place") / BITS) == k)
            deeper = own.select("fp", "place", "value", F.explode(_signatures(rest, distance)).alias("s")).select("fp", "place", "value", F.col("s.place").alias("place2"), F.col("s.value").alias("value2"))
            found = found.unionAll(_meet(deeper, ["place", "value", "place2", "value2"], every, distance, rest))
    return found


def _meet(signed: DataFrame, keys: list[str], bits: list[int], distance: int, rest: list[int] | None = None) -> DataFrame:
    a, b = signed.select(*keys, F.col("fp").alias("a")), signed.select(*keys, F.col("fp").alias("b"))
    difference = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(difference) <= distance) & (F.col("place") == _first(difference, bits, distance))
    if rest is not None:
        near = near & (F.col("place2") == _first(difference, rest, distance))
    joined = a.join(b, keys).filter(near)
    return joined.select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): the smallest node reachable.

    Labels fall to the least among the neighbours' and then to their label's own label, so paths shrink by half and
    more each round. Every round is written to the shared folder, a file for each LABEL_ROWS rows or so.
    """
    both = common.materialise(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    files = both.count() // LABEL_ROWS + 1
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels = common.materialise(labels.coalesce(files), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("least"))
        moved = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "least").alias("root"), (F.col("least") < F.col("root")).alias("changed"))
        moved = common.materialise(moved.coalesce(files), "labels")
        if not moved.filter("changed").isEmpty():
            sizes = moved.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
            total = moved.count()
            parents = sizes.join(moved.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
            jumped = common.attach(moved.drop("changed"), parents, "root", "n", total, "node")
            labels = common.materialise(jumped.select("node", F.least("root", F.coalesce("above", "root")).alias("root")).coalesce(files), "labels")
            continue
        return moved.select("node", "root")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Per row: ``id_col``, fp, component_id (the smallest id reachable over links, the row's own included).

    Fingerprints of rows link at ``distance`` or fewer differing bits; equal ones always. Rows without words (null, empty and
    blank texts) have fingerprint zero and link like any other. Texts of any length count whole. Repeated ids are rows of their
    own; a null id is passed over where any other is in the component. Other columns are left out. An empty table gives no rows.
    """
    rows = common.materialise(fingerprints(docs.select(id_col, text_col), text_col, shingle), "fingerprints")
    return _grouped(rows, id_col, distance)


def _grouped(rows: DataFrame, id_col: str, distance: int) -> DataFrame:
    fps = common.materialise(rows.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count(F.lit(1)).alias("n_rows")), "classes")
    roots = components(links(fps, distance))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n_classes"))
    sums = fps.agg(F.count(F.lit(1)), F.sum("n_rows")).first()
    classes = common.attach(rooted, least, "root", "n_classes", sums[0], "fp").select("fp", "n_rows", "component_id")
    return common.attach(rows, classes, "fp", "n_rows", sums[1] or 0, id_col).select(id_col, "fp", "component_id")


class _Hashes(dict):
    """64-bit hashes of words, kept as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, SEED)
        return h


_HASHES = _Hashes()
common.kept_by("simhash", _HASHES.clear)


def _words(text: str | None) -> np.ndarray:
    """Hashes of a text's words in lower case."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; of all of them if they are fewer. None without words."""
    n = min(n, len(words))
    if not n:
        return words
    m = len(words) - n + 1
    h = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + m]) * _MIX[0]
        h ^= h >> np.uint64(32)
    h *= _MIX[1]
    h ^= h >> np.uint64(29)
    h *= _MIX[2]
    return h ^ (h >> np.uint64(32))


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Distinct ones, in order."""
    hashes = np.sort(hashes)
    new = np.ones(len(hashes), dtype=bool)
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    return hashes[new]


def _shingles(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's distinct shingles, in order; none without words."""
    return _distinct(_runs(_words(text), shingle).view(np.int64))


def sketch(text: str | None, shingle: int = NEAR_SHINGLE) -> bytes:
    """24 bytes: the fingerprint over distinct pairs of words, by which near copies meet, and a hash of the set of distinct
    shingles. Zero bits without words."""
    words = _words(text)
    if not len(words):
        return bytes(24)
    return _majority(_distinct(_runs(words, 2)).tobytes()) + xxhash.xxh3_128_digest(_distinct(_runs(words, shingle).view(np.int64)).tobytes(), SEED)


def spanning(sketches: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Pairs (i, j) that connect all rows (64-bit words) that links of ``limit`` bits or fewer connect.

    Rows reached are taken off, so a group of copies costs about a pass over its rows for each ring around its first.
    """
    found: list[tuple[int, int]] = []
    left = np.arange(len(sketches))
    while len(left) > 1:
        ring, left = left[:1], left[1:]
        while len(ring) and len(left):
            own, ring = ring[:64], ring[64:]
            near = np.bitwise_count(sketches[own][:, None] ^ sketches[left][None]) <= limit
            hit = near.any(axis=0)
            if hit.any():
                found += zip(own[near[:, hit].argmax(axis=0)].tolist(), left[hit].tolist(), strict=True)
                ring, left = np.concatenate([ring, left[hit]]), left[~hit]
    return found


def _first_place(difference: np.ndarray) -> np.ndarray:
    """The first signature in common of fingerprints that differ in these bits: the first segment with one such bit at most."""
    width = BITS // NEAR_SEGMENTS
    place = np.full(len(difference), BITS, dtype=np.int64)
    for k in reversed(range(NEAR_SEGMENTS)):
        own = difference >> np.uint64(k * width) & np.uint64((1 << width) - 1)
        bit = np.where(own == 0, 0, np.bitwise_count(own - np.uint64(1)))
        place = np.where(np.bitwise_count(own) <= 1, k * width + bit, place)
    return place


def _meetings(limit: int, small: int):
    """For rows (key, place, node, fp) sorted by bucket: links (a, b) within each. Small buckets give all, large ones those that
    connect their rows. A link is given only at the pair's first place: where a bucket leaves a connecting link out, its two
    rows are connected at an earlier place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()

        def links_of(key: np.ndarray, place: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            """Whole buckets, one after another."""
            bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            sizes = np.diff(bounds)
            i, j = [], []
            in_small = np.repeat(sizes <= small, sizes)
            for lag in range(1, min(small, int(sizes.max()))):
                met = np.flatnonzero((key[lag:] == key[:-lag]) & in_small[lag:])
                met = met[np.bitwise_count(fps[met] ^ fps[met + lag]) <= limit]
                i.append(met)
                j.append(met + lag)
            for k in np.flatnonzero(sizes > small):
                begin, end = bounds[k], bounds[k + 1]
                if pairs := spanning(fps[begin:end], limit):
                    own = np.array(pairs) + begin
                    i.append(own[:, 0])
                    j.append(own[:, 1])
            i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (i, j))
            first = _first_place(fps[i] ^ fps[j]) == place[i]
            a, b = ids[i[first]], ids[j[first]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            key, place, ids, fps = (batch.column(k).to_numpy() for k in range(4))
            if not len(key):
                continue
            held.append((key, place, ids, fps.view(np.uint64)))
            size += len(key)
            if size >= HELD_ROWS:
                columns = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                begun = int(np.searchsorted(columns[0], columns[0][-1]))  # the last bucket may go on
                if begun:
                    yield links_of(*(x[:begun] for x in columns))
                held, size = [tuple(x[begun:] for x in columns)], len(columns[0]) - begun
        if held:
            yield links_of(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _cells(df: DataFrame, blocks: str, node: str = "node") -> DataFrame:
    """Deal rows with a number of blocks out as pairs of blocks: ``cell`` (0 where blocks is null); any two are together in one."""
    own = F.pmod(F.xxhash64(node), F.col(blocks)).cast("bigint")
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1), lambda j: F.least(own, j) * F.col(blocks) + F.greatest(own, j))
    return df.withColumn("cell", F.explode(F.when(F.col(blocks).isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(pairs)))


def near_links(sketches: DataFrame, limit: int = NEAR_BITS, block: int = BLOCK, small: int = SMALL_BUCKET) -> DataFrame:
    """Links (a < b) that connect rows of near fingerprints, of a table with one row for each sketch: node, fp (longs).

    Rows meet under the one-wildcard variants of the two 32-bit segments of ``fp``. A bucket of over ``block`` rows is dealt
    out as pairs of blocks: any two of its rows are together in some task, and no task holds more than two blocks of it.
    """
    width = BITS // NEAR_SEGMENTS
    parts = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketches = sketches.repartition(parts, "node")
    values = [F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in range(NEAR_SEGMENTS)]
    # a key is a place (segment and bit left out) and the segment's other bits
    variants = [F.lit((k * width + b) << width).cast("bigint") + value.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << b))) for k, value in enumerate(values) for b in range(width)]
    # a bucket holds the rows of two values of its segment, so one of over a block has a value of over half a block; these are few
    counted = sketches.select(F.posexplode(F.array(*values)).alias("k", "value")).groupBy("k", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block // 2)
    keys = F.expr(f"transform(sequence(0, {width - 1}), b -> shiftleft(cast(k * {width} + b as bigint), {width}) + (value & ~shiftleft(1L, b)))")
    sizes = counted.select(F.explode(keys).alias("_key"), "n").groupBy("_key").agg(F.sum("n").alias("n"))
    large = common.materialise(sizes.select("_key", F.ceil((F.col("n") + block // 2) / block).cast("bigint").alias("_blocks")), "near-large")
    n_large = large.count()
    dealt = sketches.select(F.explode(F.array(*variants)).alias("key"), "node", "fp").withColumn("place", F.shiftright("key", width).cast("int"))
    if n_large:
        marked = dealt.join(F.broadcast(large) if n_large <= BROADCAST_KEYS else large, F.col("key") == F.col("_key"), "left")
        # equal keys of different cells must not stand together
        dealt = _cells(marked, "_blocks").withColumn("key", F.when(F.col("_blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", "cell")))
    # one order of the rows for each segment: what a large group links to agrees in the segment's buckets and differs elsewhere
    sorted_out = dealt.select("key", "place", "node", "fp").repartition(parts, "key").sortWithinPartitions("key", F.xxhash64("node", F.floor(F.col("place") / width)))
    return sorted_out.mapInArrow(_meetings(limit, small), "a bigint, b bigint")


def _agree(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether the common shingles are at least ``least`` of all."""
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
        return False
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (len(x) + len(y) - shared) - 1e-9


def _verified(edges: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The links whose texts' distinct shingles agree to ``least`` or more, all shingles of both texts compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("simhash")
        known: dict[int, np.ndarray] = {}  # many links share a text
        size = 0

        def of(node: int, text: str | None) -> np.ndarray:
            nonlocal size
            if (own := known.get(node)) is None:
                own = known[node] = _shingles(text, shingle)
                size += len(own)
                if size > HELD_SHINGLES:
                    known.clear()
                    size = 0
            return own

        for batch in batches:
            found = [_agree(of(a, x), of(b, y), least) for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(found, pa.bool_()))

    asked = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = common.materialise(texts.join(asked, F.col("_doc") == F.col("node"), "left_semi"), "near-texts")
    sides = edges.join(own.select(F.col("_doc").alias("a"), F.col("text").alias("_x")), "a").join(own.select(F.col("_doc").alias("b"), F.col("text").alias("_y")), "b")
    return sides.select("a", "b", "_x", "_y").mapInArrow(run, "a bigint, b bigint")


def _prefix(hashes: np.ndarray, least: float, often: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in the order of rarity, so many that a set that agrees to ``least`` has one of them among its own
    first; and how often each was counted."""
    counted = np.zeros(len(hashes), dtype=np.int64)
    if len(often) and len(hashes):
        at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
        counted = np.where(often[at] == hashes, times[at], 0)
    level = np.floor(np.log2(np.maximum(counted, 1))).astype(np.int64)
    kept = np.lexsort((hashes, level))[: len(hashes) - math.ceil(least * len(hashes) - 1e-9) + 1]
    return hashes[kept], counted[kept]


ACROSS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("hot", T.LongType())])


def _candidates(least: float, hot_rows: int):
    """For rows (key, node, root, n, at, salt) sorted by key, salt and n: pairs (a, b) of different roots whose sizes and places
    allow ``least``; of a hot key, that is one with more than ``hot_rows`` rows or with a salt, its rows (node, root, key)."""

    def out(a: np.ndarray, b: np.ndarray, hot: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64()) if hot is None else pa.array(hot, pa.int64())], names=ACROSS.names)

    def buckets(key: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, at: np.ndarray, salt: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets, one after another."""
        bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        sizes = np.diff(bounds)
        mixed = np.minimum.reduceat(root, bounds[:-1]) != np.maximum.reduceat(root, bounds[:-1])
        hot = np.repeat((sizes > hot_rows) & mixed, sizes) | (salt > 0)
        if hot.any():
            yield out(node[hot], root[hot], key[hot])
        # a salted key's rows, and those of one root alone, have no pairs here
        live = np.flatnonzero(np.repeat((sizes <= hot_rows) & mixed, sizes) & (salt == 0))
        held: list[np.ndarray] = []
        for lag in range(1, hot_rows):
            # a row meets those after it in its bucket while their sizes allow it
            live = live[live + lag < len(key)]
            other = live + lag
            live = live[(key[other] == key[live]) & (n[live] >= least * n[other] - 1e-9)]
            if not len(live):
                break
            other = live + lag
            common_most = np.minimum(n[live] - at[live], n[other] - at[other])
            near = (root[live] != root[other]) & (common_most >= least / (1 + least) * (n[live] + n[other]) - 1e-9)
            if near.any():
                a, b = node[live[near]], node[other[near]]
                held.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        if held:
            both = np.unique(np.concatenate(held), axis=0)
            yield out(both[:, 0], both[:, 1], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        held: list[tuple[np.ndarray, ...]] = []
        size, streaming = 0, None  # the key of a bucket larger than what is held, of which a part is out already
        for batch in batches:
            columns = tuple(batch.column(k).to_numpy() for k in range(6))
            if streaming is not None and len(columns[0]):
                own = int(np.searchsorted(columns[0], streaming, "right"))
                if own:
                    yield out(columns[1][:own], columns[2][:own], columns[0][:own])
                columns = tuple(x[own:] for x in columns)
                streaming = None if len(columns[0]) else streaming
            if not len(columns[0]):
                continue
            held.append(columns)
            size += len(columns[0])
            if size >= HELD_ROWS:
                columns = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                begun = int(np.searchsorted(columns[0], columns[0][-1]))  # the last bucket may go on
                if begun:
                    yield from buckets(*(x[:begun] for x in columns))
                    held, size = [tuple(x[begun:] for x in columns)], size - begun
                else:
                    yield out(columns[1], columns[2], columns[0])
                    held, size, streaming = [], 0, columns[0][-1]
        if held:
            yield from buckets(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def spanned(sets: list[np.ndarray], roots: list[int], least: float) -> list[tuple[int, int]]:
    """Of sets of hashes (sorted, distinct) and their components: pairs that agree to ``least`` and connect all components that such
    pairs connect.

    Each row outside the largest component is compared with all rows of other components that its size allows. Shingles of
    one row alone count for its size only.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    n = np.array([len(sets[i]) for i in order])
    owner = np.repeat(np.arange(len(order)), n)
    if not len(owner):
        # rows without words agree with each other
        return [(order[0], i) for i in order[1:] if roots[i] != roots[order[0]]]
    _, ids, times = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    shared = times[ids] > 1
    ids, owner = ids[shared], owner[shared]
    bounds = np.searchsorted(owner, np.arange(len(order) + 1))
    _, label = np.unique(np.array([roots[i] for i in order]), return_inverse=True)
    marked = np.zeros(len(times), dtype=bool)
    found = []
    sizes = np.bincount(label)
    for i in np.lexsort((np.arange(len(order)), sizes[label])).tolist():
        if sizes[label[i]] == sizes.max() and label[i] == sizes.argmax():
            continue
        low, high = np.searchsorted(n, least * n[i] - 1e-9), np.searchsorted(n, n[i] / least + 1e-9, "right")
        if not (label[low:high] != label[i]).any():
            continue
        own = ids[bounds[i] : bounds[i + 1]]
        marked[own] = True
        begin, end = bounds[low], bounds[high]
        common_ones = np.bincount(owner[begin:end][marked[ids[begin:end]]] - low, minlength=high - low)
        marked[own] = False
        near = np.flatnonzero(common_ones >= least * (n[i] + n[low:high] - common_ones) - 1e-9) + low
        for j in near.tolist():
            if label[j] != label[i]:
                found.append((order[i], order[j]))
                gone = label == label[j]
                sizes[label[i]] += gone.sum()
                sizes[label[j]] = 0
                label[gone] = label[i]
    return found


def _within(shingle: int, least: float):
    """For rows (group, cell, node, root, text) sorted by group and cell: verified links (a < b) across each cell's components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("simhash")
        at, nodes, roots, sets = None, [], [], []

        def out() -> pa.RecordBatch:
            pairs = [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in spanned(sets, roots, least)] if len(set(roots)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            for group, cell, node, root, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (group, cell) != at:
                    if nodes:
                        yield out()
                    at, nodes, roots, sets = (group, cell), [], [], []
                nodes.append(node)
                roots.append(root)
                sets.append(_shingles(text, shingle))
        if nodes:
            yield out()

    return run


def _hot_links(members: DataFrame, texts: DataFrame, shingle: int, least: float, cell_rows: int, cell_bytes: int) -> DataFrame | None:
    """Verified links across components of rows that share hot keys, of rows (node, root, key). Hot keys with rows in common
    make up a group, so that a row is in one group only; a group is dealt out as pairs of blocks. None if there are none."""
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    members = common.materialise(members.join(mixed, "key", "left_semi"), "near-hot")
    if members.isEmpty():
        return None
    homes = common.materialise(members.groupBy("node").agg(F.min("key").alias("home"), F.first("root").alias("root")), "near-homes")
    together = members.join(homes.select("node", "home"), "node").select(F.col("home").alias("a"), F.col("key").alias("b")).distinct()
    groups = components(together)
    rows = homes.join(groups.select(F.col("node").alias("home"), F.col("root").alias("group")), "home").select("node", "root", "group")
    rows = common.materialise(rows.join(texts.select(F.col("_doc").alias("node"), "text"), "node"), "near-hot-texts")
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    sizes = sizes.select("group", F.ceil(F.greatest(F.col("n") / cell_rows, F.col("bytes") / cell_bytes)).cast("bigint").alias("blocks"))
    dealt = _cells(rows.join(sizes, "group"), "blocks").select("group", "cell", "node", "root", "text")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "group", "cell").sortWithinPartitions("group", "cell").mapInArrow(_within(shingle, least), "a bigint, b bigint")


def exact_links(texts: DataFrame, roots: DataFrame, shingle: int, least: float, hot_rows: int = HOT_ROWS, cell_rows: int = CELL_ROWS, cell_bytes: int = CELL_BYTES, counted_hot: int = COUNTED_HOT) -> DataFrame:
    """Links (a < b) that connect all components that pairs of shingle sets that agree to ``least`` connect; of texts (_doc, text)
    and a table with a node and its root for each row that is asked about.

    In any order of all shingles, two sets that agree to ``least`` have one in common among the first n - least * n + 1 of
    each. The order is rare ones first, so few others meet. Keys that many share are left to ``_hot_links``.
    """
    spark = texts.sparkSession

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("simhash")
        for batch in batches:
            own = [_shingles(text, shingle) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own) if own else np.zeros(0, dtype=np.int64))], names=["key"])

    counted = texts.filter(F.pmod(F.xxhash64("_doc"), F.lit(COUNTED_DOCS)) == 0).select("text").mapInArrow(every, "key bigint")
    often = counted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COUNTED_LEAST).orderBy(F.desc("n"), "key").limit(COUNTED_SHINGLES).toArrow()
    keys, times = (often.column(k).to_numpy() for k in range(2))
    order = np.argsort(keys)
    shipped = spark.sparkContext.broadcast((keys[order], times[order].astype(np.int64)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("simhash")
        for batch in batches:
            sets = [_shingles(t, shingle) for t in batch.column(1).to_pylist()]
            own = [_prefix(x, least, *shipped.value) for x in sets]
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array([k.tobytes() for k, _ in own], pa.binary()), pa.array([(n > counted_hot).tobytes() for _, n in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "first", "often"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x, dtype=np.int64) for x in batch.column(3).to_pylist()]
            hot = [np.frombuffer(x, dtype=bool) for x in batch.column(4).to_pylist()]
            sizes = np.array([len(x) for x in keys])
            if not sizes.sum():
                continue
            node, root, n = (np.repeat(batch.column(k).to_numpy(), sizes) for k in range(3))
            # a key known to be hot has no one task: its rows are dealt out by salts
            salt = np.where(np.concatenate(hot), 1 + (node.view(np.uint64) * _MIX[0] >> np.uint64(48)).astype(np.int64), 0)
            columns = (np.concatenate(keys), node, root, n, np.concatenate([np.arange(k) for k in sizes]), salt)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["key", "node", "root", "n", "at", "salt"])

    firsts = texts.select("_doc", "text").mapInArrow(first, "node bigint, n int, first binary, often binary")
    rows = firsts.join(roots, "node").select("node", "root", "n", "first", "often").mapInArrow(dealt, "key bigint, node bigint, root bigint, n int, at int, salt int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "n").mapInArrow(_candidates(least, hot_rows), ACROSS)
    met = common.materialise(met, "near-across")
    pairs = common.materialise(met.filter("hot is null").select("a", "b").distinct(), "near-met")
    links = common.materialise(_verified(pairs, texts, shingle, least), "near-links")
    hot = _hot_links(met.filter("hot is not null").select(F.col("a").alias("node"), F.col("b").alias("root"), F.col("hot").alias("key")), texts, shingle, least, cell_rows, cell_bytes)
    return links if hot is None else links.unionAll(common.materialise(hot, "near-links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, least: float = NEAR_LEAST, limit: int = NEAR_BITS) -> DataFrame:
    """One row of each group of near copies, that with the smallest id, with the columns of ``docs``.

    Rows are near copies if their distinct ``shingle``-word shingles agree to ``least``, common ones in proportion to all; groups are
    what such links connect. Most meet under the deletion variants of a fingerprint over pairs of words, which edits change
    far less than one over longer shingles, and are put to that test within ``limit`` bits; large groups with few links. What
    this leaves apart is sought by ``exact_links``, which misses no link between the components found so far.

    Rows without words are near copies of each other. Of rows that repeat an id or have none, each counts by itself, in
    the order of their texts' hashes. Other columns pass through; an empty table stays empty.
    """
    common.prepare(docs.sparkSession)
    keyed = common.keyed(common.pack(docs, id_col, text_col), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("simhash")
        for batch in batches:
            data = np.frombuffer(b"".join([sketch(t, shingle) for t in batch.column(1).to_pylist()]), dtype=">i8").astype(np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(data[:, k]) for k in range(3)]], names=["node", "fp", "set", "set2"])

    texts = keyed.select("_doc", "text")
    rows = texts.mapInArrow(run, "node bigint, fp bigint, set bigint, set2 bigint")
    # rows of equal fingerprints and equal sets of shingles are one class, which its least row stands for
    one = common.materialise(rows.groupBy("fp", "set", "set2").agg(F.min("node").alias("node")), "near-classes")
    met = common.materialise(near_links(one.select("node", "fp"), limit).distinct(), "near-met")
    edges = common.materialise(_verified(met, texts, shingle, least), "near-links")
    roots = one.select("node").join(components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    edges = edges.unionAll(exact_links(texts, roots, shingle, least))
    gone = components(edges).filter("node != root").select(F.col("node").alias("_gone"))
    heads = common.materialise(one.join(gone, F.col("node") == F.col("_gone"), "left_anti").select(F.col("node").alias("_head")), "near-heads")
    return common.unpack(keyed.join(heads, F.col("_doc") == F.col("_head"), "left_semi"), docs, id_col, text_col)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over three words and the smallest doc_id that links of two bits or fewer reach."""
    found = groups(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
