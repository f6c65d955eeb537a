"""Early warnings from a linear trend over six monthly counts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.functions import timewin as W
from casewright.operators import cases
from casewright.sources.tables import Tables

MONTHS, LEAST_TOTAL, LEAST_SLOPE = 6, 12, 0.5


def series(t: Tables, as_of: date | datetime | str) -> DataFrame:
    """district, crime_group, y (array of counts): six months up to the current, incomplete one, months without cases as 0.

    Rows are counted by conditions within one grouping, so no spine of months is joined. Later months are passed over.
    """
    at = W.moment(as_of)
    starts = [W.month_start(at, MONTHS - 1 - k) for k in range(MONTHS)]
    ends = [*starts[1:], W.month_start(at, -1)]
    recent = t["CaseMaster"].filter(W.since("CrimeRegisteredDate", starts[0]))
    counts = [C.count_if(W.within("CrimeRegisteredDate", a, b), C.weight_of(recent)).alias(f"y{k}") for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
    by_unit = recent.groupBy("PoliceStationID", "CrimeMajorHeadID").agg(*counts)
    named = cases.attach(t, by_unit, "unit", "district", "head")
    summed = named.groupBy(F.col("DistrictName").alias("district"), F.col("CrimeGroupName").alias("crime_group")).agg(*[F.sum(f"y{k}").alias(f"y{k}") for k in range(MONTHS)])
    return summed.select("district", "crime_group", F.array(*[f"y{k}" for k in range(MONTHS)]).alias("y"))


def trended(cells: DataFrame) -> DataFrame:
    """Add total, slope, intercept, projected (the next month, at least 0) and recent, from the array ``y``."""
    xs = range(MONTHS)
    n, sx, sxx = MONTHS, sum(xs), sum(x * x for x in xs)
    weighted = sum((F.get("y", F.lit(x)) * x for x in xs), F.lit(0))
    with_sums = cells.withColumn("total", F.aggregate("y", F.lit(0).cast("bigint"), lambda a, v: a + v)).withColumn("slope", (n * weighted - sx * F.col("total")) / F.lit(n * sxx - sx * sx))
    with_line = with_sums.withColumn("intercept", (F.col("total") - F.col("slope") * sx) / F.lit(n))
    return with_line.withColumn("projected", F.greatest(F.lit(0).cast("bigint"), C.half_up(F.col("intercept") + F.col("slope") * n).cast("bigint"))).withColumn("recent", F.get("y", F.lit(n - 1)))


def forecasts(t: Tables, as_of: date | datetime | str, top: int = 4) -> DataFrame:
    """Cells of district and crime group that rise: 12 cases or more, a slope over 0.5, a projection over the current month.

    district, crime_group, slope, projected, recent, score (slope and projected gain), the highest scores first.
    """
    rising = trended(series(t, as_of)).filter((F.col("total") >= LEAST_TOTAL) & (F.col("slope") > LEAST_SLOPE) & (F.col("projected") > F.col("recent")))
    scored = rising.withColumn("score", F.col("slope") + F.col("projected") - F.col("recent"))
    return scored.orderBy(F.desc("score"), "district", "crime_group").limit(top).select("district", "crime_group", "slope", "projected", "recent", "score")
