"""The 31 example questions as functions of tables, an as-of moment and parameters.

Lists give the latest 200 rows, rows without a date first and equal dates by case. Names of columns are those that
existing clients read.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.functions import timewin as W
from casewright.operators.cases import attach, latest
from casewright.sources.tables import Tables

Moment = date | datetime | str
DATE, CASE, LISTED = "CrimeRegisteredDate", "CaseMasterID", 200


def _months(as_of: Moment, n: int) -> Column:
    return W.since(DATE, W.months_before(W.moment(as_of), n))


def _this_year(as_of: Moment) -> Column:
    return W.since(DATE, W.year_start(W.moment(as_of)))


def _last_month(column: str, as_of: Moment) -> Column:
    at = W.moment(as_of)
    return W.within(column, W.month_start(at, 1), W.month_start(at))


def _list(rows: DataFrame, *columns: str) -> DataFrame:
    return latest(rows, DATE, CASE, LISTED).select(*columns)


def _counts(rows: DataFrame, name: str, *keys: str, top: int | None = None) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *keys)
    return found.limit(top) if top else found


def _people(t: Tables, table: str, cases: DataFrame) -> DataFrame:
    return t[table].join(cases, CASE)


def qx00_district_cases(t: Tables, as_of: Moment, district: str) -> DataFrame:
    rows = attach(t, t["CaseMaster"].filter(_months(as_of, 6)), "unit", "district", "head", "subhead", "status").filter(F.col("DistrictName") == district)
    return _list(rows, CASE, "CrimeNo", DATE, "UnitName", "CrimeGroupName", "CrimeHeadName", "CaseStatusName")


def qx01_group_by_district(t: Tables, as_of: Moment, group: str) -> DataFrame:
    rows = attach(t, t["CaseMaster"].filter(_this_year(as_of)), "head", "unit", "district").filter(F.col("CrimeGroupName") == group)
    return _counts(rows, "total_cases", "DistrictName")


def qx02_monthly_trend(t: Tables, as_of: Moment, group: str) -> DataFrame:
    rows = attach(t, t["CaseMaster"], "head").filter(F.col("CrimeGroupName") == group)
    return rows.groupBy(F.date_trunc("month", DATE).cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).alias("cases")).orderBy("month")


def qx03_repeat_accused(t: Tables, as_of: Moment, days: int = 30, more_than: int = 2) -> DataFrame:
    recent = t["CaseMaster"].filter(W.since(DATE, W.moment(as_of) - timedelta(days=days))).select(CASE)
    shares = C.shares(t["Accused"])
    # no task sorts or holds more than its share: the fewer cases are hashed, and people on a case are told apart before they are counted
    seen = _people(t, "Accused", recent.hint("shuffle_hash")).select("AccusedName", "AgeYear", CASE).repartition(shares, "AccusedName", "AgeYear", CASE).distinct()
    counted = seen.repartition(shares, "AccusedName", "AgeYear").groupBy("AccusedName", "AgeYear").agg(F.count(CASE).alias("case_count"))
    return counted.filter(F.col("case_count") > more_than).orderBy(F.desc("case_count"), "AccusedName", "AgeYear").limit(50)


def qx04_district_arrests(t: Tables, as_of: Moment, district: str) -> DataFrame:
    """No row, rather than a zero, where nothing matches."""
    named = t["District"].filter(F.col("DistrictName") == district).select("DistrictID", "DistrictName")
    rows = t["ArrestSurrender"].filter(_last_month("ArrestSurrenderDate", as_of)).join(named, F.col("ArrestSurrenderDistrictId") == F.col("DistrictID"))
    return rows.groupBy("DistrictName").agg(F.count(F.lit(1)).alias("total_arrests"))


def qx05_open_cases(t: Tables, as_of: Moment, district: str, status: str = "Under Investigation") -> DataFrame:
    rows = attach(t, t["CaseMaster"], "unit", "district", "head", "subhead", "status").filter((F.col("DistrictName") == district) & (F.col("CaseStatusName") == status))
    return _list(rows, CASE, "CrimeNo", DATE, "UnitName", "CrimeGroupName", "CrimeHeadName")


def qx06_top_groups(t: Tables, as_of: Moment) -> DataFrame:
    return _counts(attach(t, t["CaseMaster"].filter(_this_year(as_of)), "head"), "total_cases", "CrimeGroupName")


def qx07_female_victims(t: Tables, as_of: Moment) -> DataFrame:
    rows = attach(t, _people(t, "Victim", t["CaseMaster"].filter(_months(as_of, 12))).filter(F.col("GenderID") == 2), "head", "unit", "district")
    return _list(rows, CASE, DATE, "VictimName", "AgeYear", "CrimeGroupName", "DistrictName")


def qx08_busiest_officers(t: Tables, as_of: Moment) -> DataFrame:
    counted = t["CaseMaster"].filter(_this_year(as_of)).groupBy("PolicePersonID").agg(F.count(CASE).alias("total_cases"))
    officers = t["Employee"].select("EmployeeID", "FirstName", "DistrictID")
    rows = counted.join(officers, F.col("PolicePersonID") == F.col("EmployeeID"))
    return attach(t, rows, "district").orderBy(F.desc("total_cases"), "EmployeeID").limit(20).select("FirstName", "total_cases", "DistrictName")


def qx09_cases_of_accused(t: Tables, as_of: Moment, person: str, days: int = 30) -> DataFrame:
    recent = t["CaseMaster"].filter(W.since(DATE, W.moment(as_of) - timedelta(days=days)))
    people = t["Accused"].filter(C.contains_any_case(F.col("AccusedName"), person)).select(CASE, "AccusedMasterID", "AccusedName")
    rows = attach(t, people.join(recent, CASE), "unit", "district", "head", "subhead", "status")
    return rows.orderBy(F.col(DATE).desc_nulls_first(), CASE, "AccusedMasterID", "AccusedName").limit(LISTED).select(CASE, "CrimeNo", DATE, "UnitName", "DistrictName", "CrimeGroupName", "CrimeHeadName", "CaseStatusName")


def qx10_points(t: Tables, as_of: Moment, district: str, subhead: str) -> DataFrame:
    rows = attach(t, t["CaseMaster"].filter(F.col("latitude").isNotNull()), "unit", "district", "subhead", "status")
    return rows.filter((F.col("DistrictName") == district) & (F.col("CrimeHeadName") == subhead)).select(CASE, DATE, "latitude", "longitude", "UnitName", "CaseStatusName")


def qx11_subhead_count(t: Tables, as_of: Moment, subhead: str) -> DataFrame:
    rows = attach(t, t["CaseMaster"].filter(_this_year(as_of)), "subhead").filter(F.col("CrimeHeadName") == subhead)
    return rows.agg(F.count(F.lit(1)).alias("murder_cases"))


def qx12_chargesheets(t: Tables, as_of: Moment, kind: str = "A") -> DataFrame:
    sheets = t["ChargesheetDetails"].filter((F.col("cstype") == kind) & (F.col("csdate") >= W.instant(W.month_start(W.moment(as_of))))).drop("PolicePersonID")
    rows = attach(t, sheets.join(t["CaseMaster"], CASE), "unit", "district", "head")
    return latest(rows, "csdate", "CSID", LISTED).select("CSID", CASE, "CrimeNo", "csdate", "UnitName", "DistrictName", "CrimeGroupName")


def qx13_status_by_district(t: Tables, as_of: Moment, status: str = "False Case", name: str = "false_cases") -> DataFrame:
    return _counts(attach(t, t["CaseMaster"], "status", "unit", "district").filter(F.col("CaseStatusName") == status), name, "DistrictName")


def _group_list(t: Tables, rows: DataFrame, group: str, *columns: str) -> DataFrame:
    return _list(attach(t, rows, "head", "subhead", "unit", "district", "status").filter(F.col("CrimeGroupName") == group), CASE, "CrimeNo", DATE, "UnitName", "DistrictName", "CrimeHeadName", *columns)


def qx14_group_this_year(t: Tables, as_of: Moment, group: str) -> DataFrame:
    return _group_list(t, t["CaseMaster"].filter(_this_year(as_of)), group, "CaseStatusName")


def qx15_group_without_status(t: Tables, as_of: Moment, group: str) -> DataFrame:
    rows = attach(t, t["CaseMaster"].filter(_this_year(as_of)), "head", "subhead", "unit", "district").filter(F.col("CrimeGroupName") == group)
    return _list(rows, CASE, "CrimeNo", DATE, "UnitName", "DistrictName", "CrimeHeadName")


def qx16_group_three_months(t: Tables, as_of: Moment, group: str) -> DataFrame:
    return _group_list(t, t["CaseMaster"].filter(_months(as_of, 3)), group, "CaseStatusName")


def qx17_subhead_six_months(t: Tables, as_of: Moment, subhead: str) -> DataFrame:
    rows = attach(t, t["CaseMaster"].filter(_months(as_of, 6)), "subhead", "unit", "district", "status").filter(F.col("CrimeHeadName") == subhead)
    return _list(rows, CASE, "CrimeNo", DATE, "UnitName", "DistrictName", "CaseStatusName")


def qx18_minor_victims(t: Tables, as_of: Moment) -> DataFrame:
    rows = attach(t, _people(t, "Victim", t["CaseMaster"].filter(_this_year(as_of))).filter(F.col("AgeYear") < 18), "head", "unit", "district")
    return _list(rows, "VictimName", "AgeYear", CASE, DATE, "CrimeGroupName", "DistrictName")


def qx19_category_by_district(t: Tables, as_of: Moment, category: str = "FIR") -> DataFrame:
    rows = attach(t, t["CaseMaster"].filter(_this_year(as_of)), "unit", "district", "category").filter(F.col("CaseCategory") == category)
    return _counts(rows, "total_firs", "DistrictName")


def qx20_heinous_count(t: Tables, as_of: Moment, district: str) -> DataFrame:
    rows = attach(t, t["CaseMaster"].filter(_this_year(as_of)), "gravity", "unit", "district").filter((F.col("Gravity") == "Heinous") & (F.col("DistrictName") == district))
    return rows.agg(F.count(F.lit(1)).alias("heinous_crimes"))


def qx21_section_cases(t: Tables, as_of: Moment, act: str, section: str) -> DataFrame:
    under = t["ActSectionAssociation"].filter((F.col("ActCode") == act) & (F.col("SectionCode") == section)).select(CASE)
    rows = attach(t, under.join(t["CaseMaster"], CASE), "unit", "district", "status")
    return _list(rows, CASE, "CrimeNo", DATE, "UnitName", "DistrictName", "CaseStatusName")


def qx22_busiest_stations(t: Tables, as_of: Moment, group: str) -> DataFrame:
    rows = attach(t, t["CaseMaster"].filter(_this_year(as_of)), "head", "unit", "district").filter(F.col("CrimeGroupName") == group)
    return _counts(rows, "cybercrime_cases", "UnitName", "DistrictName", top=20)


def qx23_young_men(t: Tables, as_of: Moment) -> DataFrame:
    rows = attach(t, _people(t, "Accused", t["CaseMaster"].filter(_last_month(DATE, as_of))).filter((F.col("GenderID") == 1) & (F.col("AgeYear") < 25)), "head", "unit", "district")
    return rows.orderBy(F.col(DATE).desc_nulls_first(), CASE, "AccusedMasterID", "AccusedName").limit(LISTED).select("AccusedName", "AgeYear", CASE, DATE, "CrimeGroupName", "DistrictName")


def qx24_closed_by_district(t: Tables, as_of: Moment, status: str = "Closed") -> DataFrame:
    rows = attach(t, t["CaseMaster"].filter(_this_year(as_of)), "status", "unit", "district").filter(F.col("CaseStatusName") == status)
    return _counts(rows, "closed_cases", "DistrictName")


def qx25_age_bands(t: Tables, as_of: Moment, group: str) -> DataFrame:
    known = t["Accused"].filter(F.col("AgeYear").isNotNull())
    rows = attach(t, known.join(t["CaseMaster"].select(CASE, "CrimeMajorHeadID"), CASE), "head").filter(F.col("CrimeGroupName") == group)
    return rows.groupBy(C.age_band(F.col("AgeYear"), "-").alias("age_band")).agg(F.count(F.lit(1)).alias("accused")).orderBy("age_band")


def qx26_victim_gender(t: Tables, as_of: Moment, subhead: str) -> DataFrame:
    known = t["Victim"].filter(F.col("GenderID").isNotNull())
    rows = attach(t, known.join(t["CaseMaster"].select(CASE, "CrimeMinorHeadID"), CASE), "subhead").filter(F.col("CrimeHeadName") == subhead)
    return rows.groupBy(C.gender(F.col("GenderID")).alias("gender")).agg(F.count(F.lit(1)).alias("victims")).orderBy(F.desc("victims"), "gender")


def qx27_occupations(t: Tables, as_of: Moment, group: str) -> DataFrame:
    rows = attach(t, t["ComplainantDetails"].join(t["CaseMaster"].select(CASE, "CrimeMajorHeadID"), CASE), "head").filter(F.col("CrimeGroupName") == group)
    return _counts(rows.join(t["OccupationMaster"], "OccupationID"), "complainants", "OccupationName")


def qx28_average_age(t: Tables, as_of: Moment) -> DataFrame:
    known = t["Accused"].filter(F.col("AgeYear").isNotNull())
    rows = attach(t, known.join(t["CaseMaster"].select(CASE, "CrimeMajorHeadID"), CASE), "head")
    return rows.groupBy("CrimeGroupName").agg(F.round(F.avg("AgeYear")).alias("avg_age"), F.count(F.lit(1)).alias("accused")).orderBy("avg_age", "CrimeGroupName")


def qx29_religions(t: Tables, as_of: Moment, district: str) -> DataFrame:
    rows = attach(t, t["ComplainantDetails"].join(t["CaseMaster"].select(CASE, "PoliceStationID"), CASE), "unit", "district").filter(F.col("DistrictName") == district)
    return _counts(rows.join(t["ReligionMaster"], "ReligionID"), "complainants", "ReligionName")


def qx30_rising_districts(t: Tables, as_of: Moment) -> DataFrame:
    """Only this and the last month are scanned: a district needs cases this month to rise."""
    at = W.moment(as_of)
    low, start = W.month_start(at, 1), W.month_start(at)
    by_unit = t["CaseMaster"].filter(W.since(DATE, low)).groupBy("PoliceStationID").agg(C.count_if(W.since(DATE, start)).alias("now"), C.count_if(W.within(DATE, low, start)).alias("before"))
    found = attach(t, by_unit, "unit", "district").groupBy("DistrictName").agg(F.sum("now").alias("this_month"), F.sum("before").alias("last_month"))
    return found.filter(F.col("this_month") > F.col("last_month")).orderBy((F.col("this_month") - F.col("last_month")).desc(), "DistrictName")


# questions that front ends suggest beside the examples


def chargesheet_rate(t: Tables, as_of: Moment) -> DataFrame:
    """Share of cases with a chargesheet, in percent, by crime group."""
    filed = t["ChargesheetDetails"].select(CASE).distinct().withColumn("filed", F.lit(True))
    rows = attach(t, t["CaseMaster"].join(filed, CASE, "left"), "head")
    return rows.groupBy("CrimeGroupName").agg(F.count(F.lit(1)).alias("cases"), C.percent(F.col("filed").isNotNull()).alias("rate")).orderBy(F.desc("rate"), "CrimeGroupName")


def days_to_chargesheet(t: Tables, as_of: Moment) -> DataFrame:
    """Average days from registration to the first chargesheet, by district."""
    first = t["ChargesheetDetails"].groupBy(CASE).agg(F.min("csdate").alias("filed"))
    rows = attach(t, t["CaseMaster"].join(first, CASE), "unit", "district")
    return rows.groupBy("DistrictName").agg(F.round(F.avg(F.datediff("filed", DATE)), 1).alias("avg_days"), F.count(F.lit(1)).alias("cases")).orderBy("avg_days", "DistrictName")


def accused_in_several_districts(t: Tables, as_of: Moment, least: int = 2, top: int = 50) -> DataFrame:
    rows = attach(t, t["Accused"].filter(F.col("PersonID").isNotNull()).select(CASE, "PersonID").join(t["CaseMaster"].select(CASE, "PoliceStationID"), CASE), "unit", "district")
    distinct = rows.select("PersonID", "DistrictName").distinct()
    found = distinct.groupBy("PersonID").agg(F.count(F.lit(1)).alias("districts"))
    return found.filter(F.col("districts") >= least).orderBy(F.desc("districts"), "PersonID").limit(top)
