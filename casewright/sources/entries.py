"""Results of a service, entry by entry: a cache by content with an age for each entry, and calls at a pace that holds for the service."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions import timewin as W
from casewright.sources import store


def content(column: str) -> Column:
    """What an entry is kept under: a hash of the whole text."""
    return F.sha2(F.encode(F.col(f"`{column}`"), "utf-8"), 256)


def fresh(spark: SparkSession, path: str, now: datetime, minutes: int) -> DataFrame | None:
    """hash, value, at: of each content the youngest entry, those that are not older than ``minutes``; None if nothing is kept."""
    try:
        kept = spark.read.parquet(path)
    except AnalysisException:
        return None
    young = kept.filter((F.col("at") >= W.instant(now - timedelta(minutes=minutes))) & (F.col("at") <= W.instant(now)))
    return young.groupBy("hash").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def through(df: DataFrame, column: str, out: str, path: str, now: datetime, minutes: int, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``out`` to every row: the kept result for its text, else a new one, which is then kept.

    ``compute`` gets the distinct texts without a fresh entry (hash, text) and gives hash and value; null values aren't kept, so they are
    asked for again the next time. Each entry has its own age. Null texts have no result. Equal texts are computed once. What has been
    computed is written before it is used, so a lost executor asks for nothing twice.
    """
    spark, names = df.sparkSession, [c for c in df.columns if c != out]
    wanted = df.select(content(column).alias("hash"), F.col(f"`{column}`").alias("text")).filter("text is not null").groupBy("hash").agg(F.min("text").alias("text"))
    kept = fresh(spark, path, now, minutes)
    missing = wanted if kept is None else wanted.join(kept.select("hash"), "hash", "left_anti")
    made = compute(missing).select("hash", "value").filter("value is not null").withColumn("at", W.instant(now))
    made.write.mode("append").parquet(path)
    values = fresh(spark, path, now, minutes).select("hash", F.col("value").alias("_value"))
    packed = df.select(content(column).alias("hash"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("rest"))
    return packed.join(values, "hash", "left").select(*[F.col(f"rest.`{c}`").alias(c) for c in names], F.col("_value").alias(out))


def compacted(spark: SparkSession, path: str, to: str, now: datetime, minutes: int) -> str:
    """The fresh entries, one for each content, written to the new path ``to``; readers change over to it when they are ready."""
    kept = fresh(spark, path, now, minutes)
    (spark.read.parquet(path).limit(0) if kept is None else kept.select("hash", "value", "at")).write.parquet(to)
    return to


def paced(df: DataFrame, id_col: str, column: str, out: str, kind: str, service: Callable[[list], list], per_minute: float, slots: int = 4, batch: int = 100, in_flight: int = 2, retries: int = 2, wait: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Ask ``service`` for all values of ``column`` at ``per_minute`` values a minute over the whole cluster: id and ``out``; and the rows refused.

    The rows are dealt out to ``slots`` tasks, each of which gets its share of the pace and has up to ``in_flight`` batches on their way, so
    neither the number of executors nor that of input partitions changes what the service sees. A batch that raises, or gives another
    number of results than it was asked for, is asked again up to ``retries`` times, later each time, at the same pace; then its rows are
    refused. Results are written before anything reads them. The refused rows (id and value) are what the next run starts from.
    """
    spark, share = df.sparkSession, per_minute / slots
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("value", df.schema[column].dataType), T.StructField(out, T._parse_datatype_string(kind)), T.StructField("refused", T.BooleanType())])
    arrow = [f.dataType for f in T.StructType(schema.fields).fields]

    def ask(values: list, pause: Callable[[int], None]) -> list | None:
        for attempt in range(retries + 1):
            try:
                found = list(service(values))
                if len(found) == len(values):
                    return found
            except Exception:  # whatever the service raises, the batch is refused
                pass
            if attempt < retries:
                time.sleep(wait * 2**attempt)
                pause(len(values))
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from threading import Lock

        lock, due = Lock(), [time.monotonic()]

        def pause(n: int) -> None:
            with lock:
                at = max(due[0], time.monotonic())
                due[0] = at + 60.0 * n / share
            time.sleep(max(0.0, at - time.monotonic()))

        def one(values: list) -> list | None:
            pause(len(values))
            return ask(values, pause)

        with ThreadPoolExecutor(in_flight) as pool:
            for rows in batches:
                ids, values = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                cuts = range(0, len(values), batch)
                # of one Arrow batch, in its order
                for at, found in zip(cuts, pool.map(one, [values[at : at + batch] for at in cuts]), strict=True):
                    own, n = ids[at : at + batch], len(values[at : at + batch])
                    columns = [own, values[at : at + batch], found or [None] * n, [found is None] * n]
                    yield pa.RecordBatch.from_arrays([pa.array(c, a) for c, a in zip(columns, kinds, strict=True)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(a) for a in arrow]
    path = store.scratch(spark, "paced")
    dealt = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{column}`").alias("value")).repartition(slots)
    dealt.mapInArrow(run, schema).write.parquet(path)
    done = spark.read.schema(schema).parquet(path)
    return done.filter(~F.col("refused")).select(F.col("id").alias(id_col), out), done.filter("refused").select(F.col("id").alias(id_col), F.col("value").alias(column))
