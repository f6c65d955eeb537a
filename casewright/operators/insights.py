"""Anomalies: spikes, repeat accused, weekly surges, and the bundle of all insights."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.functions import timewin as W
from casewright.operators import cases, forecast
from casewright.sources.tables import Tables

SPIKE_FACTOR, SURGE_FACTOR, LEAST_BEFORE, LEAST_WEEK, LEAST_CASES = 1.15, 1.3, 5, 5, 3


def spikes(t: Tables, as_of: date | datetime | str, top: int = 3) -> DataFrame:
    """district_name, this_month, last_month, pct: districts whose last complete month has over 1.15 times the cases of the
    month before, if that has over 5; the largest months first. Only these two months are scanned."""
    at = W.moment(as_of)
    low, middle, high = W.month_start(at, 2), W.month_start(at, 1), W.month_start(at)
    recent = t["CaseMaster"].filter(W.within("CrimeRegisteredDate", low, high))
    by_unit = recent.groupBy("PoliceStationID").agg(C.count_if(W.since("CrimeRegisteredDate", middle), C.weight_of(recent)).alias("now"), C.count_if(F.lit(True), C.weight_of(recent)).alias("both"))
    found = cases.attach(t, by_unit, "unit", "district").groupBy(F.col("DistrictName").alias("district_name")).agg(F.sum("now").alias("this_month"), (F.sum("both") - F.sum("now")).alias("last_month"))
    now, before = F.col("this_month"), F.col("last_month")
    spiking = found.filter((before > LEAST_BEFORE) & (now > before * SPIKE_FACTOR))
    return spiking.withColumn("pct", C.change_percent(now, before)).orderBy(F.desc("this_month"), "district_name").limit(top)


def repeat_accused(t: Tables, as_of: date | datetime | str, days: int = 30, least: int = LEAST_CASES, top: int = 2) -> DataFrame:
    """accused_name, case_count, crime_types: names on ``least`` or more distinct cases of the last days, the most cases first."""
    at = W.moment(as_of)
    recent = t["CaseMaster"].filter(W.since("CrimeRegisteredDate", at - timedelta(days=days))).select("CaseMasterID", "CrimeMajorHeadID")
    named = t["Accused"].filter(F.col("AccusedName").isNotNull()).select("CaseMasterID", F.col("AccusedName").alias("accused_name"))
    return repeats_among(t, named.join(recent, "CaseMasterID"), least, top)


def repeats_among(t: Tables, entries: DataFrame, least: int = LEAST_CASES, top: int = 2) -> DataFrame:
    """As ``repeat_accused``, of entries of accused_name, CaseMasterID and CrimeMajorHeadID."""
    rows = cases.attach(t, entries, "head")
    # one row for each name, case and group first, so that the distinct count needs no second pass over all rows
    distinct = rows.groupBy("accused_name", "CaseMasterID", "CrimeGroupName").agg(F.lit(1).alias("one"))
    found = distinct.groupBy("accused_name").agg(F.count_distinct("CaseMasterID").alias("case_count"), C.listed(F.col("CrimeGroupName")).alias("crime_types"))
    return found.filter(F.col("case_count") >= least).orderBy(F.desc("case_count"), "accused_name").limit(top)


def weekly_counts(rows: DataFrame, kind: str | Column, at: str, as_of: date | datetime | str, *, dates: bool = True) -> DataFrame:
    """crime_type, this_week, last_week: rows of the last seven days and of the seven before, by kind; others aren't scanned."""
    now = W.moment(as_of)
    bound = W.day if dates else W.instant
    start, middle = bound(now - timedelta(days=14)), bound(now - timedelta(days=7))
    recent = rows.filter(F.col(at) >= start)
    return recent.groupBy(F.col(kind).alias("crime_type") if isinstance(kind, str) else kind.alias("crime_type")).agg(C.count_if(F.col(at) >= middle, C.weight_of(rows)).alias("this_week"), C.count_if(F.col(at) < middle, C.weight_of(rows)).alias("last_week"))


def surge_of(counts: DataFrame) -> DataFrame:
    """The kind with the most rows this week, if those are over 5 and over 1.3 times last week's; else no row. With pct."""
    now, before = F.col("this_week"), F.col("last_week")
    largest = counts.filter(now > LEAST_WEEK).orderBy(F.desc("this_week"), "crime_type").limit(1)
    return largest.filter(now > before * SURGE_FACTOR).withColumn("pct", C.change_percent(now, before))


def weekly_surge(t: Tables, as_of: date | datetime | str) -> DataFrame:
    """The surging crime group. The largest is chosen before it is tested: a smaller one that surges doesn't count."""
    by_head = weekly_counts(t["CaseMaster"], "CrimeMajorHeadID", "CrimeRegisteredDate", as_of)
    named = cases.attach(t, by_head.withColumnRenamed("crime_type", "CrimeMajorHeadID"), "head")
    return surge_of(named.groupBy(F.col("CrimeGroupName").alias("crime_type")).agg(F.sum("this_week").alias("this_week"), F.sum("last_week").alias("last_week")))


def _cards(rows: DataFrame, group: int, kind: str, title: Column, detail: Column, query: Column, order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.orderBy(*order))  # a handful of rows
    return rows.select((F.lit(1000 * group) + place).cast("int").alias("seq"), F.lit(kind).alias("type"), title.alias("title"), detail.alias("detail"), query.alias("query"))


def insights(t: Tables, as_of: date | datetime | str, repeats: DataFrame | None = None) -> DataFrame:
    """seq, type, title, detail, query: spikes, repeat accused (``repeats``, if they are known), the weekly surge, forecasts, in this order of seq."""
    say = F.format_string
    # The types, titles, details and questions are what results show.
    parts = [
        _cards(
            spikes(t, as_of),
            1,
            "spike",
            say("Crime spike in %s", "district_name"),
            say("%s%% jump last month (%s vs %s the month before)", F.col("pct").cast("string"), F.col("this_month").cast("string"), F.col("last_month").cast("string")),
            say("Show crime breakdown in %s for the last 2 months", "district_name"),
            [F.desc("this_month"), F.col("district_name")],
        ),
        _cards(
            repeat_accused(t, as_of) if repeats is None else repeats,
            2,
            "repeat_suspect",
            say("Repeat accused: %s", "accused_name"),
            say("Linked to %s cases in last 30 days (%s)", F.col("case_count").cast("string"), F.col("crime_types")),
            say("Show all cases linked to accused %s in the last 30 days", "accused_name"),
            [F.desc("case_count"), F.col("accused_name")],
        ),
        _cards(weekly_surge(t, as_of), 3, "weekly_surge", say("%s surging statewide", "crime_type"), say("%s%% more %s cases this week vs last week", F.col("pct").cast("string"), F.col("crime_type")), say("Show %s hotspots in the last 7 days with map", "crime_type"), [F.col("crime_type")]),
        _cards(
            forecast.forecasts(t, as_of),
            4,
            "forecast",
            say("%s rising in %s", "crime_group", "district"),
            say("Trending up ~%s/month · projected %s next month (vs %s this month)", F.format_string("%.1f", F.col("slope")), F.col("projected").cast("string"), F.col("recent").cast("string")),
            say("Show monthly trend of %s in %s", "crime_group", "district"),
            [F.desc("score"), F.col("district"), F.col("crime_group")],
        ),
    ]
    bundle = parts[0]
    for part in parts[1:]:
        bundle = bundle.unionByName(part)
    return bundle


def briefing(bundle: DataFrame, n: int = 3) -> DataFrame:
    """The first insight of each type, the first ``n`` of these."""
    return C.top_per_group(bundle, ["type"], [F.col("seq")]).orderBy("seq").limit(n)
