"""Token-ID binary output in training order.

Documents become fixed-length token sequences with dense numbers. A keyed Feistel permutation with cycle-walking assigns
every sequence a global slot: the permutation is over a power of four that is at least the number of sequences, and values
outside go through it again until they fall inside. Slots are dealt to shards by range, and each shard is written in slot
order with a fixed stride, so that slot s lies at a known place of a known file: reads are sequential and can resume at any slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

WINDOW = 2048
END_ID = 2
PAD_ID = 0
KEY = 20_240_229
ROUNDS = 6
#: Sequences in a shard.
SHARD_SLOTS = 4096
SEQUENCES = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("k", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("packed", T.BinaryType())])
SHARDS = T.StructType([T.StructField("slot", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("byte_offset", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("ids_crc32", T.LongType())])


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A well-mixed 64-bit function of x under a key."""
    x = x + np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of these indices: a permutation of 0 ... size - 1 that the key chooses."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(k) for k in _mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), key & (1 << 64) - 1)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right, k) & mask)
        return left << shift | right

    out = once(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= size)):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer_path: str, text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, pad_id: int = PAD_ID, dtype: str = "<u2") -> DataFrame:
    """Token sequences of ``window`` ids: the documents of an input partition one after another, each with ``end_id`` at its end.

    The last sequence of a partition is padded with ``pad_id``; n_tokens leaves the padding out. Ids are packed with Zstandard
    on their way. part and k number the sequences; numbers within a part are dense.
    """
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from zstandard import ZstdCompressor

        common.alone("tokens")
        part, packer, encoder = TaskContext.get().partitionId(), ZstdCompressor(level=6), tokens.word_encoder(tokenizer_path)
        end, held, k = np.array([end_id], dtype="<u4").tobytes(), b"", 0

        def out(data: bytes) -> pa.RecordBatch:
            nonlocal k
            ids = np.frombuffer(data, dtype="<u4")
            if len(ids) and ids.max() > np.iinfo(dtype).max:
                raise ValueError("an id doesn't fit the output's width")
            n = -(-len(ids) // window)
            sizes = [window] * (n - 1) + [len(ids) - window * (n - 1)]
            rows = np.full(n * window, pad_id, dtype=dtype)
            rows[: len(ids)] = ids
            rows = rows.reshape(n, window)
            batch = pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(k, k + n), pa.int64()), pa.array(sizes, pa.int32()), pa.array([packer.compress(r.tobytes()) for r in rows], pa.binary())], names=SEQUENCES.names)
            k += n
            return batch

        for batch in batches:
            held += b"".join(ids + end for ids in encoder.encode(batch.column(0).to_pylist()))
            whole = len(held) // (4 * window) * 4 * window
            if whole:
                yield out(held[:whole])
                held = held[whole:]
        if held:
            yield out(held)

    return docs.select(text_col).mapInArrow(run, SEQUENCES)


def placed(made: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """The rows of ``sequences``, written before, with their slots: slot, n_tokens, packed; and how many there are."""
    # two numbers for each input partition
    counts = sorted((r.part, r.n) for r in made.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    size, firsts = 0, []
    for part, n in counts:
        firsts.append((part, size))
        size += n

    @F.pandas_udf("bigint")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), size, key))

    # sent to the sequences: Spark doesn't know how small it is beforehand, and would deal out all sequences by part
    bases = F.broadcast(made.sparkSession.createDataFrame(firsts, "part int, base bigint"))
    return made.join(bases, "part").select(slot(F.col("base") + F.col("k")).alias("slot"), "n_tokens", "packed"), size


def write(docs: DataFrame, folder: str, tokenizer_path: str, text_col: str = "text", window: int = WINDOW, key: int = KEY, shard_slots: int = SHARD_SLOTS, dtype: str = "<u2") -> DataFrame:
    """Write all sequences in training order to shards in ``folder`` (a URI all executors share); returns the manifest by slot.

    A shard is written under its attempt's name and then moved, so a lost executor leaves no half shard; a shard that is
    there already with the very same bytes is kept, so a run can be resumed, and one of another key, vocabulary or text is
    replaced. Shards that an earlier, longer run left behind the last one aren't read. Null and empty texts give their end id alone; repeated
    rows are documents of their own; ids and other columns aren't used. An empty table gives no shard.
    """
    stride = window * np.dtype(dtype).itemsize
    made = common.materialise(sequences(docs, tokenizer_path, text_col, window, dtype=dtype), "sequences")
    rows, size = placed(made, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext
        from zstandard import ZstdDecompressor

        store, root = fs.FileSystem.from_uri(folder)
        unpacker, found, parts, attempt = ZstdDecompressor(), [], [], TaskContext.get().taskAttemptId()
        for batch in batches:
            for s, n, packed in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ids = unpacker.decompress(packed, max_output_size=stride)
                parts.append(ids)
                found.append((s, s // shard_slots, s % shard_slots * stride, n, zlib.crc32(ids)))
        if found:
            path, data = f"{root}/{shard_name(found[0][1])}", b"".join(parts)
            if not _holds(store, path, data):
                with store.open_output_stream(f"{path}.{attempt}", compression=None) as f:
                    f.write(data)
                store.move(f"{path}.{attempt}", path)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()], strict=True)], names=SHARDS.names)

    dealt = rows.repartitionById(max(1, -(-size // shard_slots)), F.floor(F.col("slot") / shard_slots).cast("int")).sortWithinPartitions("slot")
    dealt.mapInArrow(run, SHARDS).write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(SHARDS).parquet(f"{folder}/manifest")


def _holds(store, path: str, data: bytes) -> bool:
    """Whether the file is there with these bytes."""
    there = store.get_file_info(path)
    if not there.is_file or there.size != len(data):
        return False
    with store.open_input_stream(path, compression=None) as f:
        step = 1 << 20
        return all(f.read(step) == data[at : at + step] for at in range(0, len(data), step))


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_slots(folder: str, start: int, stop: int, window: int = WINDOW, shard_slots: int = SHARD_SLOTS, dtype: str = "<u2") -> Iterator[np.ndarray]:
    """Sequences of slots start ... stop - 1 in order; a reader that stopped goes on from its next slot."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    stride = window * np.dtype(dtype).itemsize
    while start < stop:
        shard, first = divmod(start, shard_slots)
        last = min(stop, (shard + 1) * shard_slots)
        with store.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(first * stride)
            for _ in range(last - start):
                data = f.read(stride)
                if len(data) < stride:
                    return
                yield np.frombuffer(data, dtype=dtype)
        start = last


def read(spark: SparkSession, folder: str, window: int = WINDOW, shard_slots: int = SHARD_SLOTS, dtype: str = "<u2") -> DataFrame:
    """Every sequence of the manifest's shards: slot, shard, byte_offset, ids (bytes)."""
    stride = window * np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder)
    shard = F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("bigint")
    common.prepare(spark)
    last = spark.read.schema(SHARDS).parquet(f"{folder}/manifest").agg(F.max("shard")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                offsets = list(range(0, len(data), stride))
                yield pa.RecordBatch.from_arrays([pa.array([number * shard_slots + o // stride for o in offsets], pa.int64()), pa.array([number] * len(offsets), pa.int64()), pa.array(offsets, pa.int64()), pa.array([data[o : o + stride].tobytes() for o in offsets], pa.binary())], names=["slot", "shard", "byte_offset", "ids"])

    return files.select(shard.alias("shard"), "content").filter(F.col("shard") <= F.lit(-1 if last is None else last)).mapInArrow(run, "slot bigint, shard bigint, byte_offset bigint, ids binary")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of the shards written of all documents, with what the writer and a reader found there."""
    folder = common.run_dir(spark, "shards")
    manifest = write(common.read(spark, sf_dir, "documents"), folder, tokens.vocabulary_path("word_bpe_49k.json"))
    back = read(spark, folder).select("slot", F.crc32("ids").alias("read_crc32"))
    return manifest.join(back, "slot").select("slot", "shard", "byte_offset", "n_tokens", "ids_crc32", "read_crc32")
