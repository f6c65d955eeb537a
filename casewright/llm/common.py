"""Helpers that the operators share: the cluster's shared folder, materialised tables, joins that bear hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes of ``[\x20\x09-\x0D]``, the white space that all contracts here name.
SPACES = b" \t\n\x0b\x0c\r"
#: The same as a class for Java's regular expressions.
SPACE_CLASS = "\\x20\\x09-\\x0D"
#: A key is hot if it holds more than this share of the rows; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 0.001
BATCH_BYTES = 4 << 20
_SHIPPED: set[str] = set()
_DROPS: dict[str, Callable[[], object]] = {}


def kept_by(owner: str, drop: Callable[[], object]) -> None:
    """Say how to drop what a module keeps in a worker process from task to task."""
    _DROPS[owner] = drop


def alone(owner: str | None = None) -> None:
    """At a task's start: drop what other modules than ``owner`` keep in this worker process, which earlier stages left, and
    give memory that is free back to the system, as workers live on beside the executor."""
    for name, drop in _DROPS.items():
        if name != owner:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets a new
    temporary one; on a cluster it is an error, as other machines couldn't read what one writes to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="casewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def run_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/casewright-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses neither recompute it nor depend on live executors."""
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, row_id: str) -> DataFrame:
    """``left`` join ``right`` (one row per key) on ``key``, left rows without a partner kept with nulls.

    ``weight`` counts the left rows of a key and ``total`` all of them. Keys with more than HOT_SHARE of the rows are at
    most 1 / HOT_SHARE in number, so they are broadcast; their left rows then carry no key into the shuffle join, but are
    dealt out by ``row_id``. The others meet in an ordinary shuffle join.
    """
    columns = [c for c in right.columns if c != key]
    limit = HOT_SHARE * max(total, 1)
    hot = right.filter(F.col(weight) > limit).select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in columns])
    cold = right.filter(F.col(weight) <= limit).select(F.col(key).cast("string").alias("_cold_key"), *[F.col(c).alias(f"_cold_{c}") for c in columns])
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    dealt = F.when(F.col("_hot_key").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("#"), F.xxhash64(row_id).cast("string")))
    joined = marked.withColumn("_dealt", dealt).join(cold, F.col("_dealt") == F.col("_cold_key"), "left")
    return joined.select(*[F.col(c) for c in left.columns], *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in columns])


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and all other columns as one struct ``rest``, so that no name of theirs meets one that an operator adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("rest"))


def unpack(df: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``docs`` again."""
    named = {id_col: "doc_id", text_col: "text"}
    return df.select(*[F.col(named[c] if c in named else f"rest.`{c}`").alias(c) for c in docs.columns])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Add ``_doc``, a distinct long without nulls in the ids' order: the id itself, or, if ids repeat or are missing, a
    number that rises with them (equal ids in the order of their texts' hashes), written to the shared folder."""
    rows = docs.select(*[c for c in docs.columns if c != "_doc"])
    if rows.groupBy(id_col).count().filter(F.col("count").__gt__(1) | F.col(id_col).isNull()).isEmpty():
        return rows.withColumn("_doc", F.col(id_col).cast("bigint"))
    # in a sorted table, partitions are in order as well, so these numbers rise with the rows
    return materialise(rows.orderBy(id_col, F.xxhash64(text_col)).withColumn("_doc", F.monotonically_increasing_id()), "keyed")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """For operators with Python parts: executors get this package, and texts travel to them in batches of ``rows`` rows and
    BATCH_BYTES at most, so that a batch of long texts stays small beside a worker's memory. Results are lazy, so the two
    settings stay with the session; an operator's own results don't depend on them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="casewright-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(package.rglob("*.py")):
                z.write(path, path.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
