"""Files around the tables: examples, snapshots with an age limit, audit logs, exports, enrichment from services."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions import timewin as W

AUDIT = "at timestamp_ntz, run_id string, step int, tool string, args string, status string, row_count bigint, error string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; with a local master and none named, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="casewright-")
    return f"{base.rstrip('/')}/casewright-{name}-{uuid.uuid4().hex}"


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """idx, question, sql from a JSON array of question and SQL pairs, in the file's order."""
    rows = spark.read.schema("question string, sql string").option("multiLine", True).json(path)
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", T.ArrayType(rows.schema))).alias("idx", "e"))
    return whole.select("idx", "e.question", "e.sql")


def save_snapshot(df: DataFrame, path: str, at: datetime) -> None:
    """Keep a result with the moment it was computed at."""
    df.withColumn("computed_at", W.instant(at)).write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str, now: datetime, minutes: int) -> DataFrame | None:
    """The kept result, if it is there and not older than ``minutes``; an empty one counts as missing."""
    try:
        kept = spark.read.parquet(path)
    except AnalysisException:
        return None
    fresh = kept.filter(F.col("computed_at") >= W.instant(now - timedelta(minutes=minutes)))
    return None if fresh.isEmpty() else fresh.drop("computed_at")


def read_through(spark: SparkSession, path: str, now: datetime, minutes: int, compute: Callable[[], DataFrame]) -> DataFrame:
    """The kept result or a new one, which is then kept."""
    if (kept := load_snapshot(spark, path, now, minutes)) is not None:
        return kept
    save_snapshot(compute(), path, now)
    return spark.read.parquet(path).drop("computed_at")


def append_audit(spark: SparkSession, path: str, records: Sequence[dict[str, Any]], format: str = "json") -> None:
    """Append audit records (fields of AUDIT; args as any JSON value) as JSON lines or Parquet; never fails the caller."""
    try:
        schema = T._parse_datatype_string(AUDIT)
        rows = [tuple(json.dumps(r[n]) if n == "args" and r.get(n) is not None else r.get(n) for n in schema.names) for r in records]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").format(format).save(path)
    except Exception as e:  # an audit log that can't be written must not stop the query it records
        print(f"audit record not written: {e}")


def append_records(records: DataFrame, path: str, format: str = "json") -> None:
    """Append audit records that are rows already (columns of AUDIT, those that are missing as null), from all tasks at once."""
    schema = T._parse_datatype_string(AUDIT)
    shown = [(F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    records.select(*shown).write.mode("append").format(format).save(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; fields are quoted as RFC 4180 has it, nulls are empty."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def for_print(df: DataFrame, rows: int = 100) -> DataFrame:
    """The rows of a printed report."""
    return df.limit(rows)


def enriched(df: DataFrame, column: str, out: str, kind: str, service: Callable[[list], list], batch: int = 100, per_minute: float | None = None, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """Add what ``service`` gives for the values of ``column``, asked in batches on the executors; null where it gives none.

    The service is any importable or picklable function from a list of values to a list of results (embeddings, texts). A
    task asks no faster than ``per_minute`` values a minute, if that is given. A refused batch is asked again up to ``retries``
    times, each time after twice the wait; if it is refused still, its results are null, and the others go on.
    """
    rest = [c for c in df.columns if c != out]
    schema = df.select(*rest, F.lit(None).cast(kind).alias(out)).schema

    def asked(values: list) -> list:
        for attempt in range(retries + 1):
            try:
                found = service(values)
                return found + [None] * (len(values) - len(found))
            except Exception:
                if attempt < retries:
                    time.sleep(wait * 2**attempt)
        return [None] * len(values)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = time.monotonic()
        for frame in frames:
            values: list = []
            for at in range(0, len(frame), batch):
                own = frame[column].iloc[at : at + batch].tolist()
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic()) + (60.0 * len(own) / per_minute if per_minute else 0.0)
                values += asked(own)
            yield frame.assign(**{out: pd.Series(values, index=frame.index, dtype=object)})

    return df.select(*rest).mapInPandas(run, schema)


def events(rows: DataFrame, question: str) -> Iterator[dict[str, Any]]:
    """A result as a stream of events: a step, its columns, the rows one by one, the end. Rows come partition by partition."""
    yield {"type": "step", "status": "pending", "question": question}
    yield {"type": "meta", "columns": rows.columns}
    n = 0
    for row in rows.toLocalIterator():
        n += 1
        yield {"type": "row", "row": row.asDict(recursive=True)}
    yield {"type": "done", "rows": n}


def event_lines(rows: DataFrame, question: str) -> DataFrame:
    """place, data: the same events as JSON texts made where the rows are; to be written as files, in the order of place. The last counts the rows."""
    spark, columns = rows.sparkSession, F.array(*[F.lit(c) for c in rows.columns])
    say = lambda place, **parts: spark.range(1).select(F.lit(place).alias("place"), F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()])).alias("data"))
    head = say(0, type=F.lit("step"), status=F.lit("pending"), question=F.lit(question)).unionAll(say(1, type=F.lit("meta"), columns=columns))
    body = rows.select(F.lit(2).alias("place"), F.to_json(F.struct(F.lit("row").alias("type"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")), {"ignoreNullFields": "false"}).alias("data"))
    tail = rows.agg(F.lit(3).alias("place"), F.to_json(F.struct(F.lit("done").alias("type"), F.count(F.lit(1)).alias("rows"))).alias("data"))
    return head.unionAll(body).unionAll(tail)


def server_sent(stream: Iterator[dict[str, Any]]) -> Iterator[str]:
    """Events in the text form that browsers read."""
    for event in stream:
        yield f"data: {json.dumps(event, default=str, ensure_ascii=False)}\n\n"
