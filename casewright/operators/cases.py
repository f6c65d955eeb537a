"""Cases with their dimensions: counts by district, search, case files, map data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.operators import names
from casewright.sources.tables import Tables

#: A dimension's table, its key, the cases' (or, for districts, the units') key, and what it needs first.
DIMENSIONS = {
    "unit": ("Unit", "UnitID", "PoliceStationID", ["UnitName", "DistrictID"]),
    "district": ("District", "DistrictID", "DistrictID", ["DistrictName"]),
    "head": ("CrimeHead", "CrimeHeadID", "CrimeMajorHeadID", ["CrimeGroupName"]),
    "subhead": ("CrimeSubHead", "CrimeSubHeadID", "CrimeMinorHeadID", ["CrimeHeadName"]),
    "status": ("CaseStatusMaster", "CaseStatusID", "CaseStatusID", ["CaseStatusName"]),
    "category": ("CaseCategory", "CaseCategoryID", "CaseCategoryID", ["LookupValue AS CaseCategory"]),
    "gravity": ("GravityOffence", "GravityOffenceID", "GravityOffenceID", ["LookupValue AS Gravity"]),
    "officer": ("Employee", "EmployeeID", "PolicePersonID", ["FirstName AS OfficerName"]),
    "court": ("Court", "CourtID", "CourtID", ["CourtName"]),
}


def attach(t: Tables, rows: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Join dimensions to case rows. Small ones are broadcast by their measured size, which Spark decides."""
    for name in names:
        table, key, own, columns = DIMENSIONS[name]
        dimension = t[table].selectExpr(f"{key} AS _key", *columns)
        rows = rows.join(dimension, F.col(own) == F.col("_key"), how).drop("_key")
    return rows


def latest(rows: DataFrame, date: str, key: str, n: int, *, nulls_first: bool = True) -> DataFrame:
    """The latest ``n`` rows; rows without a date are first, as databases have it for descending order, or last."""
    order = F.col(date).desc_nulls_first() if nulls_first else F.col(date).desc_nulls_last()
    return rows.orderBy(order, F.col(key)).limit(n)


def district_counts(t: Tables) -> DataFrame:
    """name, count: cases by district, most first."""
    units = t["CaseMaster"].groupBy("PoliceStationID").agg(F.count(F.lit(1)).alias("n"))
    found = attach(t, units, "unit", "district").groupBy(F.col("DistrictName").alias("name")).agg(F.sum("n").alias("count"))
    return found.orderBy(F.desc("count"), "name")


def search(t: Tables, term: str = "", limit: int = 100) -> DataFrame:
    """Cases whose district, crime group or crime number holds the term in any case (all cases for an empty term), latest first.

    At most 200 rows; a limit below 1 is refused.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    rows = attach(t, t["CaseMaster"], "head", "unit", "district")
    if term := term.strip():
        rows = rows.filter(C.contains_any_case(F.col("DistrictName"), term) | C.contains_any_case(F.col("CrimeGroupName"), term) | C.contains_any_case(F.col("CrimeNo"), term))
    rows = attach(t, rows, "status", how="left")
    return latest(rows, "CrimeRegisteredDate", "CaseMasterID", min(limit, 200), nulls_first=False).select(
        F.col("CaseMasterID").alias("case_id"),
        F.col("CrimeNo").alias("crime_no"),
        F.col("CaseNo").alias("case_no"),
        C.iso_day(F.col("CrimeRegisteredDate")).alias("date_registered"),
        F.col("CrimeGroupName").alias("crime_group"),
        F.col("DistrictName").alias("district"),
        F.coalesce("CaseStatusName", F.lit("Unknown")).alias("status"),
    )


def case_files(t: Tables, cases: DataFrame | None = None) -> DataFrame:
    """One nested row for each case (of ``cases``, a table of CaseMasterID, or of all): the header, and its victims,
    accused, arrests, chargesheets and sections as sorted arrays, empty where there are none.

    The child tables are reduced together to a row for each case before they are joined, so children never multiply each other.
    """
    only = (lambda df: df) if cases is None else (lambda df: df.join(cases.select("CaseMasterID").distinct(), "CaseMasterID", "left_semi"))
    head = attach(t, only(t["CaseMaster"]), "unit", "district", "head", "subhead", "status", "category", "gravity", "officer", "court", how="left")
    named = C.gender(F.col("GenderID"), "Transgender").alias("gender")
    accused = only(t["Accused"])
    names = accused.select(F.col("AccusedMasterID").alias("_accused"), "AccusedName")
    districts = t["District"].select(F.col("DistrictID").alias("_district"), F.col("DistrictName").alias("arrest_district"))
    arrests = only(t["ArrestSurrender"]).join(names, F.col("AccusedMasterID") == F.col("_accused"), "left").join(districts, F.col("ArrestSurrenderDistrictId") == F.col("_district"), "left")
    officers = t["Employee"].select(F.col("EmployeeID").alias("_officer"), F.col("FirstName").alias("filed_by"))
    sheets = only(t["ChargesheetDetails"]).join(officers, F.col("PolicePersonID") == F.col("_officer"), "left")
    sections = only(t["ActSectionAssociation"]).select("CaseMasterID", "ActCode", "SectionCode").join(t["Section"].select("ActCode", "SectionCode", "SectionDescription"), ["ActCode", "SectionCode"], "left")
    children = {
        "victims": (only(t["Victim"]), ["VictimName", "AgeYear", named]),
        "accused": (accused, ["AccusedName", "AgeYear", named]),
        "arrests": (arrests, ["ArrestSurrenderDate", "AccusedName", "arrest_district"]),
        "chargesheet": (sheets, ["csdate", "cstype", "filed_by"]),
        "act_sections": (sections, ["ActCode", "SectionCode", "SectionDescription"]),
    }
    # all children in one table, so that one shuffle by case brings each case's rows together
    rows = [df.select(F.col("CaseMasterID").alias("_case"), F.struct(*fields).alias(name)) for name, (df, fields) in children.items()]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).groupBy("_case").agg(*[F.sort_array(F.collect_list(name)).alias(name) for name in children])
    head = head.join(together, F.col("CaseMasterID") == F.col("_case"), "left").drop("_case")
    head = head.withColumns({name: F.coalesce(name, F.array().cast(together.schema[name].dataType)) for name in children})
    return head.select(
        "CaseMasterID",
        F.col("CrimeNo").alias("crime_no"),
        F.col("CaseNo").alias("case_no"),
        F.col("CrimeRegisteredDate").alias("registered"),
        F.col("BriefFacts").alias("brief_facts"),
        "latitude",
        "longitude",
        F.col("UnitName").alias("station"),
        F.col("DistrictName").alias("district"),
        F.col("CrimeGroupName").alias("crime_group"),
        F.col("CrimeHeadName").alias("crime_name"),
        F.col("CaseStatusName").alias("status"),
        F.col("CaseCategory").alias("case_category"),
        F.col("Gravity").alias("gravity"),
        F.col("OfficerName").alias("officer_name"),
        F.col("CourtName").alias("court"),
        *children,
    )


def case_file(t: Tables, case_id: int) -> DataFrame:
    """The file of one case; no row if there is no such case. The filter reaches every scan."""
    if isinstance(case_id, bool) or not isinstance(case_id, int):
        raise ValueError("a case's id is a whole number")
    only = Tables({k: t[k].filter(F.col("CaseMasterID") == case_id) if k in PER_CASE else t[k] for k in t})
    return case_files(only)


PER_CASE = ("CaseMaster", "Victim", "Accused", "ArrestSurrender", "ChargesheetDetails", "ActSectionAssociation")


def map_data(counts: DataFrame, places: DataFrame) -> DataFrame:
    """District counts (name, count) with coordinates, rank, and share of the largest count.

    ``places`` (name, latitude, longitude, in key order ``seq``) is a small gazetteer. A district takes the place of the same name, else
    the first whose name holds or is held by its own in any case; districts without a place are left out, after ranking.
    """
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "name"))).withColumn("share", F.col("count") / F.greatest(F.max("count").over(Window.partitionBy()), F.lit(1)))
    keyed = places.select(F.col("name").alias("_place"), "latitude", "longitude", "seq")
    pairs = names.either(counts.select("name"), places.select("name"), "name", "name")
    near = ranked.withColumn("a", F.lower("name")).join(pairs, "a").join(keyed.withColumn("b", F.lower("_place")), "b")
    first = C.top_per_group(near, ["name"], [(F.col("name") == F.col("_place")).desc(), F.col("seq")])
    return first.select("rank", "name", "count", "share", "latitude", "longitude")
