"""Demographic profiles of accused, victims and complainants, and of the typical offender by crime group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.operators import cases
from casewright.sources.tables import Tables


def accused_age(t: Tables) -> DataFrame:
    known = t["Accused"].filter(F.col("AgeYear").isNotNull())
    return known.groupBy(C.age_band(F.col("AgeYear")).alias("age_band")).agg(F.count(F.lit(1)).alias("accused")).orderBy("age_band")


def _genders(rows: DataFrame, name: str) -> DataFrame:
    known = rows.filter(F.col("GenderID").isNotNull())
    return known.groupBy(C.gender(F.col("GenderID")).alias("gender")).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), "gender")


def accused_gender(t: Tables) -> DataFrame:
    return _genders(t["Accused"], "accused")


def victim_gender(t: Tables) -> DataFrame:
    return _genders(t["Victim"], "victims")


def _complainants(t: Tables, own: str, table: str, key: str, value: str, name: str, top: int | None) -> DataFrame:
    counted = t["ComplainantDetails"].groupBy(own).agg(F.count(F.lit(1)).alias("n"))
    named = counted.join(t[table].select(F.col(key).alias("_key"), F.col(value).alias(name)), F.col(own) == F.col("_key"))
    found = named.groupBy(name).agg(F.sum("n").alias("complainants")).orderBy(F.desc("complainants"), name)
    return found.limit(top) if top else found


def occupations(t: Tables, top: int = 12) -> DataFrame:
    return _complainants(t, "OccupationID", "OccupationMaster", "OccupationID", "OccupationName", "occupation", top)


def religions(t: Tables) -> DataFrame:
    return _complainants(t, "ReligionID", "ReligionMaster", "ReligionID", "ReligionName", "religion", None)


def castes(t: Tables, top: int = 12) -> DataFrame:
    return _complainants(t, "CasteID", "CasteMaster", "caste_master_id", "caste_master_name", "caste", top)


def offenders(t: Tables) -> DataFrame:
    """crime_group, avg_age, male_pct, repeat_pct over accused of known age; a repeat is a person on two or more cases.

    The percentages' base holds all these rows, with those of unknown gender or person.
    """
    often = t["Accused"].filter(F.col("PersonID").isNotNull()).groupBy(F.col("PersonID").alias("_person")).agg(F.count_distinct("CaseMasterID").alias("_cases")).filter(F.col("_cases") >= 2)
    known = t["Accused"].filter(F.col("AgeYear").isNotNull()).select("CaseMasterID", "AgeYear", "GenderID", "PersonID")
    rows = cases.attach(t, known.join(t["CaseMaster"].select("CaseMasterID", "CrimeMajorHeadID"), "CaseMasterID"), "head")
    marked = rows.join(often, F.col("PersonID") == F.col("_person"), "left")
    found = marked.groupBy(F.col("CrimeGroupName").alias("crime_group")).agg(F.round(F.avg("AgeYear")).alias("avg_age"), C.percent(F.col("GenderID") == 1).alias("male_pct"), C.percent(F.col("_cases").isNotNull()).alias("repeat_pct"))
    return found.orderBy("crime_group")


PROFILES = {"accused_age": accused_age, "accused_gender": accused_gender, "victim_gender": victim_gender, "occupation": occupations, "religion": religions, "caste": castes, "offender": offenders}


def profile(t: Tables, which: str) -> DataFrame:
    """One of PROFILES by name."""
    return PROFILES[which](t)
