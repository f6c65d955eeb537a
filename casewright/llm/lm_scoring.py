"""Language-model scoring by context-tree weighting over bytes.

A text is scored as its words in lower case with single spaces between and an end byte. Each byte is decomposed into eight
binary decisions; for each decision and each context of 0 to DEPTH bytes before, zeros and ones are counted over all training
texts. At every node of a context tree the Krichevsky-Trofimov estimate is weighted, half and half, against the product of
its children's weighted probabilities. The posterior weights then mix the estimates of all depths into one prediction.

The model stays where its counts are. Texts are cut into chunks, and each chunk asks about its distinct strings of DEPTH + 1
bytes and its distinct words:

1. Chunks' strings are dealt out by their nearest BOUNDARY bytes of context, so a task holds whole subtrees. It adds the counts up
   and passes the subtrees' weighted probabilities to the nodes above, of which there are 65,536 at most.
2. The nodes above are weighted on the driver and shipped.
3. The questions come to the subtrees, and the answers go back to the chunks, which score their texts with them.

Beside it, a unigram baseline with add-one smoothing is computed from exact counts of all words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DEPTH = 5
#: Bytes of context of the subtrees that are dealt out; nodes above have fewer.
BOUNDARY = 3
#: A chunk ends after so many bytes of text or distinct words.
CHUNK_BYTES = 16_000_000
CHUNK_WORDS = 400_000
#: Strings whose subtrees are computed at a time.
BATCH_GRAMS = 150_000
#: Words are dealt out by so many buckets of their hash; a bucket's words from all chunks are added up at once.
WORD_BUCKETS = 16_384
END = 0x0A
_PAD = bytes([END]) * DEPTH
_REST = np.uint64((1 << 8 * (DEPTH + 1 - BOUNDARY)) - 1)
_BOUND = np.uint64(8 * (DEPTH + 1 - BOUNDARY))
#: A part is a bucket of words or a context of BOUNDARY bytes; first and second are words and counts, rests of strings and counts, or
#: packed lines and what belongs to them.
CUT = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("first", T.BinaryType()), T.StructField("second", T.BinaryType())])
_WORDS, _GRAMS, _LINES = range(3)


def _keys(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each line and its end: the bytes before it, nearest first, and the byte itself, as one number; and where
    each line's numbers begin."""
    data = np.frombuffer(b"".join([_PAD + t + b"\n" for t in lines]), dtype=np.uint8)
    sizes = np.array([len(t) + DEPTH + 1 for t in lines])
    n = len(data) - DEPTH
    keys = data[DEPTH:].astype(np.uint64)
    for k in range(1, DEPTH + 1):
        keys |= data[DEPTH - k : len(data) - k].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - k))
    scored = np.ones(len(data), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    for k in range(DEPTH):
        scored[starts + k] = False
    own = sizes - DEPTH
    return keys[scored[DEPTH:]] if n else keys, np.cumsum(own) - own


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(n[order], new)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.diff(np.r_[new, len(keys)])


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Stretches of an array as binary values."""
    offsets = (np.asarray(bounds) * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _by_top(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys in order: the contexts of BOUNDARY bytes, and where each one's keys begin and end."""
    tops = (keys >> _BOUND).astype(np.int32)
    bounds = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1], True])
    return tops[bounds[:-1]], bounds


def _batch(chunk, kind: int, part: pa.Array, first: pa.Array, second: pa.Array) -> pa.RecordBatch:
    m = len(part)
    chunk = pa.nulls(m, pa.int64()) if chunk is None else pa.array(chunk if isinstance(chunk, list) else [chunk] * m, pa.int64())
    return pa.RecordBatch.from_arrays([chunk, pa.array([kind] * m, pa.int32()), part, first, second], names=CUT.names)


def cut(docs: DataFrame, id_col: str, text_col: str, buckets: int = WORD_BUCKETS) -> DataFrame:
    """Three kinds of rows by chunk: distinct words with their training counts by bucket, distinct strings with theirs by the nearest
    bytes of context, and packed lines with their documents' ids."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from zstandard import ZstdCompressor

        common.alone()
        packer = ZstdCompressor(level=3)
        chunk, size = TaskContext.get().partitionId() << 24, 0
        words: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            by_bucket: dict[int, list[bytes]] = {}
            for word in words:
                by_bucket.setdefault(xxhash.xxh3_64_intdigest(word) % buckets, []).append(word)
            names = list(by_bucket.values())
            counts = np.array([words[w] for own in names for w in own], dtype="<u4")
            bounds = np.cumsum([0, *map(len, names)])
            yield _batch(chunk, _WORDS, pa.array(list(by_bucket), pa.int32()), pa.array([b"\n".join(own) for own in names], pa.binary()), _blobs(counts, bounds))
            keys, n = _summed(*(np.concatenate(x) for x in zip(*grams, strict=True)))
            tops, bounds = _by_top(keys)
            yield _batch(chunk, _GRAMS, pa.array(tops), _blobs((keys & _REST).astype("<u4"), bounds), _blobs(n.astype("<u4"), bounds))

        for batch in batches:
            if not batch.num_rows:
                continue
            lines = [b" ".join((t or "").encode().lower().split()) for t in batch.column(2).to_pylist()]
            ids, held = batch.column(0), np.array(batch.column(1).to_pylist(), dtype=bool)
            facts = np.stack([ids.fill_null(0).to_numpy().astype("<i8"), np.array(ids.is_null().to_pylist(), dtype="<i8"), held.astype("<i8")])
            yield _batch(chunk, _LINES, pa.array([0], pa.int32()), pa.array([packer.compress(b"\n".join(lines))], pa.binary()), pa.array([facts.tobytes()], pa.binary()))
            for asked in (False, True):
                own = [line for line, h in zip(lines, held.tolist(), strict=True) if h == asked]
                if not own:
                    continue
                keys, n = _counted(_keys(own)[0])
                grams.append((keys, np.zeros_like(n) if asked else n))
                for line in own:
                    words.update(dict.fromkeys(line.split(), 0) if asked else line.split())
            size += sum(map(len, lines))
            if len(grams) > 12:
                grams[:] = [_summed(*(np.concatenate(x) for x in zip(*grams, strict=True)))]
            if size >= CHUNK_BYTES or len(words) >= CHUNK_WORDS:
                yield from flush()
                words, grams, size, chunk = Counter(), [], 0, chunk + 1
        if grams:
            yield from flush()

    return docs.select(F.col(id_col).cast("bigint"), F.coalesce("held_out", F.lit(False)), text_col).mapInArrow(run, CUT)


def _told_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (chunk, part, words, counts) sorted by part: each word's log of one more than its count in all chunks; and rows with
    sums (chunk null): tokens, different words."""
    common.alone()
    held: list[tuple[int, list[bytes], np.ndarray]] = []
    at, tokens, kinds = None, 0, 0

    def out() -> pa.RecordBatch:
        nonlocal tokens, kinds
        sums: Counter = Counter()
        for _, words, counts in held:
            for word, n in zip(words, counts.tolist(), strict=True):
                sums[word] += n
        tokens += sum(sums.values())
        kinds += sum(n > 0 for n in sums.values())
        logs = [np.log10(np.array([sums[w] for w in words], dtype="<f8") + 1).tobytes() for _, words, _ in held]
        return _batch([c for c, _, _ in held], _WORDS, pa.array([at] * len(held), pa.int32()), pa.array([b"\n".join(w) for _, w, _ in held], pa.binary()), pa.array(logs, pa.binary()))

    for batch in batches:
        for chunk, part, words, counts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if part != at and held:
                yield out()
                held = []
            at = part
            held.append((chunk, words.split(b"\n"), np.frombuffer(counts, dtype="<u4")))
    if held:
        yield out()
    yield _batch(None, _WORDS, pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([np.array([tokens, kinds], dtype="<i8").tobytes()], pa.binary()))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series after eight steps of the recurrence."""
    y = x + 8
    product = np.ones_like(x)
    for k in range(8):
        product *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(product)


_HALVES = _lgamma(np.arange(4096) + 0.5)
_WHOLES = _lgamma(np.arange(4096) + 1.0)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones (whole numbers)."""
    total = zeros + ones
    small = np.minimum(total, 4095).astype(np.int64)
    found = _HALVES[np.minimum(zeros, small).astype(np.int64)] + _HALVES[np.minimum(ones, small).astype(np.int64)] - _WHOLES[small]
    large = np.nonzero(total > 4095)
    z, o = zeros[large].astype(np.float64), ones[large].astype(np.float64)
    found[large] = _lgamma(z + 0.5) + _lgamma(o + 0.5) - _lgamma(z + o + 1)
    return found - np.log(np.pi)


class Subtrees:
    """The nodes of BOUNDARY to DEPTH bytes of context over distinct keys in order, with their counts (0 for keys only asked about).

    A run is a node and decision. For each depth and level of decision, ``runs`` leads from a key to its run, and the others
    hold each run's numbers.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        self.runs: dict[int, list[np.ndarray]] = {}
        self.own: dict[int, list[np.ndarray]] = {}
        self.weight: dict[int, list[np.ndarray]] = {}
        below: list[np.ndarray] | None = None
        for depth in range(DEPTH, BOUNDARY - 1, -1):
            code = keys >> np.uint64(8 * (DEPTH + 1 - depth)) << np.uint64(8) | keys & np.uint64(255)
            order = np.argsort(code, kind="stable") if depth < DEPTH else np.arange(len(keys))
            code = code[order]
            new = np.r_[True, code[1:] != code[:-1]]
            first = np.flatnonzero(new)
            place = np.empty(len(keys), dtype=np.int32)
            place[order] = np.cumsum(new) - 1
            code, n = code[first], np.add.reduceat(counts[order], first)
            runs, own, weight, weighted = [], [], [], []
            for level in range(8):
                part = code >> np.uint64(8 - level)
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                run = np.zeros(len(code), dtype=np.int32)
                run[starts[1:]] = 1
                ones = np.add.reduceat(n * (code >> np.uint64(7 - level) & np.uint64(1)).astype(np.int64), starts)
                total = np.add.reduceat(n, starts)
                run = np.cumsum(run, dtype=np.int32)
                estimate = _kt(total - ones, ones)
                mixed = estimate if below is None else np.logaddexp(estimate, np.bincount(run[place[self._first[level]]], weights=below[level], minlength=len(starts))) - np.log(2)
                runs.append(run[place])
                own.append((ones + 0.5) / (total + 1))
                weight.append(np.exp(estimate - np.log(2) - mixed))
                weighted.append(mixed)
            # a key of each run, by which the run above is found
            self._first = []
            for run, mixed in zip(runs, weighted, strict=True):
                some = np.empty(len(mixed), dtype=np.int64)
                some[run] = np.arange(len(keys))
                self._first.append(some)
            self.runs[depth], self.own[depth], self.weight[depth], below = runs, own, weight, weighted
        self.weighted = below

    def above(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the nodes above need, as (node, slot, value): sums of weighted log probabilities, at slots 1 to 255 by decision."""
        nodes, slots, values = [], [], []
        for level in range(8):
            key = self.keys[self._first[level]]
            nodes.append((key >> np.uint64(8 * (DEPTH + 2 - BOUNDARY))).astype(np.int64))
            slots.append((1 << level) + (key >> np.uint64(8 - level) & np.uint64((1 << level) - 1)).astype(np.int64))
            values.append(self.weighted[level])
        return np.concatenate(nodes), np.concatenate(slots), np.concatenate(values)

    def log10(self, top: Top) -> np.ndarray:
        """Log10 probability of each key's last byte after its context."""
        out = np.zeros(len(self.keys))
        combine = top.at((self.keys >> np.uint64(8 * (DEPTH + 2 - BOUNDARY))).astype(np.int64))
        for level in range(8):
            # a context that was never seen has no counts, so its estimate is one half, as is all below it
            mixed = self.own[DEPTH][level][self.runs[DEPTH][level]]
            for depth in range(DEPTH - 1, BOUNDARY - 1, -1):
                run = self.runs[depth][level]
                own, w = self.own[depth][level][run], self.weight[depth][level][run]
                mixed = w * own + (1 - w) * mixed
            decision = (1 << level) + (self.keys >> np.uint64(8 - level) & np.uint64((1 << level) - 1)).astype(np.int64)
            bit = (self.keys >> np.uint64(7 - level) & np.uint64(1)).astype(np.int64)
            out += np.log10(combine(bit, decision, np.where(bit, mixed, 1 - mixed)))
        return out


class Top:
    """The nodes of fewer than BOUNDARY (three) bytes of context, at most 65,536 of two: what they make of the mixture below.

    ``keep``, ``alone1`` and ``root`` have a part for zeros and one for ones: a likely bit's rounded probability says nothing of the other's.
    """

    def __init__(self, nodes: np.ndarray, keep: np.ndarray, pass_on: np.ndarray, nodes1: np.ndarray, alone1: np.ndarray, root: np.ndarray):
        self.nodes, self.keep, self.pass_on, self.nodes1, self.alone1, self.root = nodes, keep, pass_on, nodes1, alone1, root

    def at(self, context: np.ndarray):
        """For contexts of two bytes: a function of bits, decisions and the bits' mixtures below. Below a context that was never seen all is one half."""

        def place(nodes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(nodes):
                return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
            at = np.minimum(np.searchsorted(nodes, wanted), len(nodes) - 1)
            return at, nodes[at] == wanted

        k, known = place(self.nodes, context)
        k1, known1 = place(self.nodes1, context >> 8)

        def combined(bit: np.ndarray, decision: np.ndarray, mixed: np.ndarray) -> np.ndarray:
            out = self.root[bit, decision]
            if known1.any():
                out = np.where(known1, self.alone1[bit, k1, decision], out)
            if known.any():
                out = np.where(known, self.keep[bit, k, decision] + self.pass_on[k, decision] * mixed, out)
            return out

        return combined


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of a byte's decisions 1 to 255 (0 is unused), from counts of bytes (contexts x 256)."""
    zeros, ones = [np.zeros((len(counts), 1))], [np.zeros((len(counts), 1))]
    for level in range(8):
        sums = counts.reshape(len(counts), 1 << level, 2, 128 >> level).sum(axis=3)
        zeros.append(sums[:, :, 0])
        ones.append(sums[:, :, 1])
    return np.concatenate(zeros, axis=1), np.concatenate(ones, axis=1)


def _top(node: np.ndarray, slot: np.ndarray, value: np.ndarray) -> Top:
    """From sums by node of two bytes: weighted logs below by decision (slots 1 to 255), counts by byte (slots 256 to 511)."""
    nodes = np.unique(node)
    nodes1, parent = np.unique(nodes >> 8, return_inverse=True)
    counts, below = np.zeros((len(nodes), 256)), np.zeros((len(nodes), 256))
    at = np.searchsorted(nodes, node)
    counts[at[slot >= 256], slot[slot >= 256] - 256] = value[slot >= 256]
    below[at[slot < 256], slot[slot < 256]] = value[slot < 256]

    def node_of(counts: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        zeros, ones = _bits(counts)
        estimate = _kt(zeros, ones)
        weighted = np.logaddexp(estimate, below) - np.log(2)
        return weighted, np.exp(estimate - np.log(2) - weighted), (np.stack([zeros, ones]) + 0.5) / (zeros + ones + 1)

    def up(rows: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 256))
        np.add.at(out, to, rows)
        return out

    weighted2, w2, own2 = node_of(counts, below)
    counts1 = up(counts, parent, len(nodes1))
    weighted1, w1, own1 = node_of(counts1, up(weighted2, parent, len(nodes1)))
    _, w0, own0 = node_of(counts1.sum(axis=0, keepdims=True), weighted1.sum(axis=0, keepdims=True))
    alone1 = w0 * own0 + (1 - w0) * (w1 * own1 + (1 - w1) / 2)
    keep1, pass1 = (w0 * own0 + (1 - w0) * w1 * own1)[:, parent], ((1 - w0) * (1 - w1))[parent]
    few = lambda x: x.astype(np.float32)
    return Top(nodes, few(keep1 + pass1 * w2 * own2), few(pass1 * (1 - w2)), nodes1, few(alone1), (w0 * own0 + (1 - w0) / 2)[:, 0])


def _whole(top: int, rests: bytes) -> np.ndarray:
    return np.frombuffer(rests, dtype="<u4").astype(np.uint64) | np.uint64(top) << _BOUND


MODEL = T.StructType([T.StructField("top", T.IntegerType()), T.StructField("rests", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("node", T.IntegerType()), T.StructField("slot", T.IntegerType()), T.StructField("value", T.DoubleType())])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (top, rests, counts) sorted by top: the counts added up (top, rests, counts), and what the nodes above need (node, slot, value)."""
    common.alone()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, at = 0, None

    def out() -> Iterator[pa.RecordBatch]:
        keys, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        tops, bounds = _by_top(keys)
        m = len(tops)
        yield pa.RecordBatch.from_arrays([pa.array(tops), _blobs((keys & _REST).astype("<u4"), bounds), _blobs(n.astype("<i8"), bounds), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.float64())], names=MODEL.names)
        node, slot, value = Subtrees(keys, n).above()
        node = np.concatenate([node, (keys >> np.uint64(8 * (DEPTH + 2 - BOUNDARY))).astype(np.int64)])
        slot = np.concatenate([slot, 256 + (keys & np.uint64(255)).astype(np.int64)])
        which, value = _summed(node << 9 | slot, np.concatenate([value, n.astype(np.float64)]))
        m = len(which)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array((which >> 9).astype(np.int32)), pa.array((which & 511).astype(np.int32)), pa.array(value)], names=MODEL.names)

    for batch in batches:
        for top, rests, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if top != at and size >= BATCH_GRAMS:
                yield from out()
                held, size = [], 0
            elif size >= 4 * BATCH_GRAMS and len(held) > 1:
                held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
            n = np.frombuffer(counts, dtype="<u4").astype(np.int64)
            seen = n > 0
            held.append((_whole(top, rests)[seen], n[seen]))
            size, at = size + len(n), top
    if held and any(len(k) for k, _ in held):
        yield from out()


def _answers(top_nodes):
    """For rows (top, chunk, rests, counts) sorted by top, the model's (chunk null) before those that ask: the asked strings' logs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        above = Top(*top_nodes.value)
        model: list[tuple[int, np.ndarray, np.ndarray]] = []
        asked: list[tuple[int, int, bytes]] = []
        size = 0

        def out() -> pa.RecordBatch:
            own = [_whole(top, rests) for _, top, rests in asked]
            wanted = np.concatenate(own)
            keys, n = _summed(np.concatenate([*[k for _, k, _ in model], wanted]), np.concatenate([*[n for _, _, n in model], np.zeros(len(wanted), dtype=np.int64)]))
            found = Subtrees(keys, n).log10(above).astype("<f4")[np.searchsorted(keys, wanted)]
            return _batch([x[0] for x in asked], _GRAMS, pa.array([x[1] for x in asked], pa.int32()), pa.array([x[2] for x in asked], pa.binary()), _blobs(found, np.r_[0, np.cumsum([len(x) for x in own])]))

        at = None
        for batch in batches:
            for top, chunk, rests, counts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size >= BATCH_GRAMS and asked and (top != at or len(asked) > 1):
                    yield out()
                    # a context that goes on keeps its model
                    model, asked = [m for m in model if m[0] == top], []
                    size = sum(len(m[1]) for m in model) if top != at else 0
                if chunk is None:
                    if not asked and size >= BATCH_GRAMS and top != at:
                        model, size = [], 0  # nobody asks about these
                    model.append((top, _whole(top, rests), np.frombuffer(counts, dtype="<i8")))
                else:
                    asked.append((chunk, top, rests))
                size, at = size + len(rests) // 4, top
        if asked:
            yield out()

    return run


SCORED = T.StructType([T.StructField("doc", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_sum", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("n_bytes", T.LongType())])


class Lookup:
    """Values by key, in an open-addressing table that is asked about many keys at a time; all of them must be there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        self.mask = np.int64((1 << (64 - int(self.shift))) - 1)
        self.keys = np.full(int(self.mask) + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.zeros(len(self.keys), dtype=values.dtype)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == np.iinfo(np.uint64).max]
            self.keys[slot[free]] = keys[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.values[slot] = values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        left = np.flatnonzero(self.keys[slot] != keys)
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            left = left[self.keys[slot[left]] != keys[left]]
        return self.values[slot]


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (chunk, kind, part, first, second) sorted by chunk, kind and part: answers about words, then about strings, then the
    chunk's lines; the texts' sums."""
    from zstandard import ZstdDecompressor

    common.alone()
    unpacker = ZstdDecompressor()
    at, words, grams = None, {}, []
    lookup = Lookup(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32))

    def out(lines: list[bytes], facts: np.ndarray) -> pa.RecordBatch:
        codes, starts = _keys(lines)
        scores = np.add.reduceat(lookup.of(codes), starts, dtype=np.float64)
        known, sums, sizes = [], [], []
        for line in lines:
            own = list(map(words.__getitem__, line.split()))
            sizes.append(len(own) + 1)
            known.append(len(own) - own.count(0.0))
            sums.append(sum(own))
        columns = [pa.array(facts[0], mask=facts[1] > 0), pa.array(facts[2] > 0), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores), pa.array([len(x) + 1 for x in lines], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=SCORED.names)

    for batch in batches:
        for chunk, kind, part, first, second in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if chunk != at:
                at, words, grams = chunk, {}, []
            if kind == _WORDS:
                words.update(zip(first.split(b"\n"), np.frombuffer(second, dtype="<f8").tolist(), strict=True))
            elif kind == _GRAMS:
                grams.append((_whole(part, first), np.frombuffer(second, dtype="<f4")))
            else:
                if grams:
                    lookup, grams = Lookup(*(np.concatenate(x) for x in zip(*grams, strict=True))), []
                yield out(unpacker.decompress(first, max_output_size=1 << 31).split(b"\n"), np.frombuffer(second, dtype="<i8").reshape(3, -1))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = WORD_BUCKETS) -> DataFrame:
    """Per row: ``id_col`` (integer), held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. Learns from the rows
    whose ``held_out`` is false.

    score is the model's log10 probability of the whole text, that is of its words in lower case with single spaces between, and an
    end; other white space isn't told apart. bits_per_byte is the code length of that in proportion. Null and empty texts hold
    the end alone. Texts of any length count whole. A word counts as unknown if no training text has it. With no training text,
    base and model still give probabilities. A null ``held_out`` counts as false. Repeated rows and ids are scored row by row; other columns are left out; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_docs = docs.filter(~F.coalesce("held_out", F.lit(False))).count()
    pieces = common.materialise(cut(docs, id_col, text_col, buckets), "lm-chunks")
    of_kind = lambda kind: pieces.filter(F.col("kind") == kind)
    words = of_kind(_WORDS).select("chunk", "part", "first", "second").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_told_words, CUT)
    words = common.materialise(words, "lm-words")
    # a row for each task
    sums = np.sum([np.frombuffer(bytes(r[0]), dtype="<i8") for r in words.filter("chunk is null").select("second").collect()] or [[0, 0]], axis=0)
    total, kinds = int(sums[0]) + n_docs, int(sums[1]) + (n_docs > 0)

    grams = of_kind(_GRAMS)
    model = common.materialise(grams.select("part", "first", "second").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_fitted, MODEL), "lm-model")
    sums = model.filter("node is not null").groupBy("node", "slot").agg(F.sum("value").alias("value")).toArrow()
    top = _top(*(sums[c].to_numpy().astype(kind) for c, kind in (("node", np.int64), ("slot", np.int64), ("value", np.float64))))
    shipped = spark.sparkContext.broadcast((top.nodes, top.keep, top.pass_on, top.nodes1, top.alone1, top.root))
    none = lambda kind: F.lit(None).cast(kind)
    questions = model.filter("top is not null").select(F.col("top").alias("part"), none("bigint").alias("chunk"), "rests", "counts").unionAll(grams.select("part", "chunk", "first", none("binary")))
    answers = questions.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(_answers(shipped), CUT)

    told = words.filter("chunk is not null").unionAll(answers).unionAll(of_kind(_LINES))
    # chunks are large, so they get more tasks than there are partitions elsewhere
    found = told.repartition(4 * parts, "chunk").sortWithinPartitions("chunk", "kind", "part").mapInArrow(_scored, SCORED)
    end = float(np.log10(n_docs + 1))
    return found.select(
        F.col("doc").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.lit(int(n_docs > 0))).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base_sum") + F.lit(end) - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from the folds that aren't held out."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", common.fold("doc_id", 7) == 2)
    return score(docs)
