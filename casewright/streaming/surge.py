"""Weekly counts by kind over a stream of events, and the surge among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def weekly(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """week_start, event_type, n: events by seven-day window (aligned to Thursdays, as epoch weeks are); events that come
    later than ``late`` behind the newest are dropped, and state is kept no longer."""
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", "7 days"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("week_start"), "event_type", "n")


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there to Parquet and stop; the checkpoint lets the next call go on from there."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


def rolling(stream: DataFrame, late: str = "1 day", every: str = "1 day") -> DataFrame:
    """until, event_type, this_week, last_week: for every ``every``, the events of the last seven days and of the seven before, by kind.

    An event counts in all periods of 14 days that hold it, also when it comes late, by up to ``late``; a period is given out once no event of
    it can come any more, and its state goes then.
    """
    period = F.window("ts", "14 days", every)
    dated = stream.withWatermark("ts", late).withColumn("period", period)
    recent = F.col("ts") >= F.col("period.start") + F.expr("INTERVAL 7 DAYS")
    counted = dated.groupBy("period", "event_type").agg(F.count(F.when(recent, 1)).alias("this_week"), F.count(F.when(~recent, 1)).alias("last_week"))
    return counted.select(F.col("period.end").alias("until"), "event_type", "this_week", "last_week")


def surges(counts: DataFrame, least: int = 5, factor: float = 1.3) -> DataFrame:
    """until, event_type, this_week, last_week: of each period the kind with the most events this week (ties: the first by name), if they are
    over ``least`` and over ``factor`` times last week's."""
    largest = counts.filter(F.col("this_week") > least).groupBy("until").agg(F.min(F.struct((-F.col("this_week")).alias("n"), "event_type", "last_week")).alias("top"))
    found = largest.select("until", F.col("top.event_type").alias("event_type"), (-F.col("top.n")).alias("this_week"), F.col("top.last_week").alias("last_week"))
    return found.filter(F.col("this_week") > F.col("last_week") * factor)
