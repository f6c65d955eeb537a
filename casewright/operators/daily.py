"""Insights kept up day by day: partial counts of each day are stored, and a refresh reads only the days that are new or have late rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.functions import timewin as W
from casewright.operators import insights
from casewright.sources.tables import Tables

REPEAT_DAYS = 30


def refresh(t: Tables, path: str, days: Sequence[tuple[date, date]]) -> None:
    """Count the cases of the named stretches of days (from, to: not included) anew, in place of what was kept of them.

    Kept are, for each day, its cases by station and head, and its accused by name, case and head. Days that aren't named stay as they
    are, so new days and days with late rows are all that is read. A day that has no rows any more keeps what it had, so name it only
    if it has some. Rows without a date are in no day.
    """
    registered = t["CaseMaster"]
    at = F.col("CrimeRegisteredDate")
    within = F.lit(False)
    for low, high in days:
        within = within | W.within("CrimeRegisteredDate", W.moment(low), W.moment(high))
    read = registered.filter(within).select("CaseMasterID", "PoliceStationID", "CrimeMajorHeadID", at.cast("date").alias("day"))
    counted = read.groupBy("day", "PoliceStationID", "CrimeMajorHeadID").agg(F.count(F.lit(1)).alias("n"))
    named = t["Accused"].filter(F.col("AccusedName").isNotNull()).select("CaseMasterID", F.col("AccusedName").alias("accused_name"))
    entries = named.join(read.select("CaseMasterID", "CrimeMajorHeadID", "day"), "CaseMasterID").distinct()
    for name, rows in (("cases", counted), ("accused", entries)):
        # a day's rows come together, so that each day is one file or few
        rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{name}")


def kept(t: Tables, path: str) -> tuple[Tables, DataFrame]:
    """The dimensions of ``t`` with the kept counts in place of the cases, and the kept entries of accused."""
    spark = t["CaseMaster"].sparkSession
    counts = spark.read.parquet(f"{path}/cases").select(F.col("day").cast("date").alias("CrimeRegisteredDate"), "PoliceStationID", "CrimeMajorHeadID", F.col("n").alias(C.WEIGHT))
    # the case tables may hold moments; counts of days compare with them alike, as all bounds are days
    return Tables({**{k: t[k] for k in t if k not in ("CaseMaster", "Accused")}, "CaseMaster": counts}), spark.read.parquet(f"{path}/accused")


def insights_kept(t: Tables, path: str, as_of: date | datetime | str) -> DataFrame:
    """As ``insights.insights``, from what is kept; only the days that count are read."""
    tables, entries = kept(t, path)
    since = W.moment(as_of) - timedelta(days=REPEAT_DAYS)
    recent = entries.filter(W.since("day", since)).select("accused_name", "CaseMasterID", "CrimeMajorHeadID")
    return insights.insights(tables, as_of, insights.repeats_among(t, recent))
