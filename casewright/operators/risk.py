"""How likely a case is to be charge-sheeted: an open formula over five features, with its reasons."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.functions import timewin as W
from casewright.operators import cases
from casewright.sources import store
from casewright.sources.tables import Tables

DAYS = 180


# The labels and reasons below are what results show.
def with_risk(rows: DataFrame) -> DataFrame:
    """Add probability, label and contributions (array of label, sign, strength) to rows with has_arrest, days, heinous and
    accused_count. Missing features count as no arrest, no days, not heinous, no accused."""
    arrest, heinous = F.coalesce("has_arrest", F.lit(False)), F.coalesce("heinous", F.lit(False))
    elapsed = F.least(F.greatest(F.coalesce(F.col("days").cast("double"), F.lit(0.0)), F.lit(0.0)) / DAYS, F.lit(1.0))
    probability = F.when(arrest, (20 + 60 * elapsed) / (68 + 60 * elapsed)).otherwise(F.lit(0.02))
    p = F.col("probability")
    label = F.when(p >= 0.5, "Likely charge-sheeted").when(p >= 0.25, "Moderate likelihood").otherwise("Unlikely to be charge-sheeted")
    reason = lambda text, sign, strength: F.struct(text.alias("label"), sign.alias("sign"), strength.cast("double").alias("strength"))
    reasons = F.array(
        F.when(arrest, reason(F.lit("Arrest made (precondition for chargesheet)"), F.lit("+"), F.lit(0.9))).otherwise(reason(F.lit("No arrest yet — chargesheet is rare without one"), F.lit("-"), F.lit(0.9))),
        F.when(arrest, reason(F.concat(F.lit("Investigation time elapsed ("), C.half_up(elapsed * 100).cast("string"), F.lit("% of the ~180-day window)")), F.when(elapsed >= 0.5, "+").otherwise("-"), F.abs(elapsed - 0.35))),
        F.when(heinous, reason(F.lit("Heinous offence — higher investigative priority"), F.lit("+"), F.lit(0.25))),
        F.when(F.col("accused_count") > 1, reason(F.concat(F.lit("Multiple accused ("), F.col("accused_count").cast("string"), F.lit(") named")), F.lit("+"), F.lit(0.1))),
    )
    return rows.withColumn("probability", probability).withColumn("label", label).withColumn("contributions", F.filter(reasons, lambda x: x.isNotNull()))


def case_features(t: Tables, as_of: date | datetime | str) -> DataFrame:
    """CaseMasterID, has_arrest, days (since registration), heinous, victim_count, accused_count of every case."""
    kinds = {"arrests": "ArrestSurrender", "victim_count": "Victim", "accused_count": "Accused"}
    # one shuffle for the three tables, and one join
    rows = reduce(DataFrame.unionAll, [t[table].select(F.col("CaseMasterID").alias("_case"), F.lit(name).alias("kind")) for name, table in kinds.items()])
    counts = rows.groupBy("_case").agg(*[C.count_if(F.col("kind") == name).alias(name) for name in kinds])
    rows = cases.attach(t, t["CaseMaster"], "gravity", how="left").join(counts, F.col("CaseMasterID") == F.col("_case"), "left")
    rows = rows.withColumns({name: F.coalesce(name, F.lit(0).cast("bigint")) for name in kinds})
    days = F.datediff(F.lit(W.moment(as_of).date()), "CrimeRegisteredDate")
    return rows.select("CaseMasterID", (F.col("arrests") > 0).alias("has_arrest"), days.alias("days"), (F.coalesce("Gravity", F.lit("")) == "Heinous").alias("heinous"), "victim_count", "accused_count")


def likeliest_class(rows: DataFrame, probabilities: str, label: str = "label") -> DataFrame:
    """Add the class of greatest probability from a map or array of (class, probability) structs in order; the first of ties."""
    entries = F.map_entries(probabilities) if rows.schema[probabilities].dataType.typeName() == "map" else F.col(probabilities)
    best = F.aggregate(entries, F.get(entries, F.lit(0)), lambda a, x: F.when(x["value"] > a["value"], x).otherwise(a))
    return rows.withColumn(label, best["key"])


def classified(rows: DataFrame, features: list[str], service: Callable[[list], list], label: str = "label") -> DataFrame:
    """Add probabilities (a map by class) that a service gives for rows of features written as text, and the likeliest class."""
    asked = rows.withColumn("_features", F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in features])))
    told = store.enriched(asked, "_features", "probabilities", "map<string,double>", service)
    return likeliest_class(told.drop("_features"), "probabilities", label)
