"""The case tables: their schemas, how they are loaded, and an adapter from star-schema tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Table and column names of the case schema that existing queries name.
SCHEMAS = {
    "State": "StateID int, StateName string, NationalityID int, Active boolean",
    "District": "DistrictID int, DistrictName string, StateID int, Active boolean",
    "UnitType": "UnitTypeID int, UnitTypeName string, CityDistState string, Hierarchy int, Active boolean",
    "Unit": "UnitID bigint, UnitName string, TypeID int, ParentUnit bigint, NationalityID int, StateID int, DistrictID int, Active boolean",
    "Rank": "RankID int, RankName string, Hierarchy int, Active boolean",
    "Designation": "DesignationID int, DesignationName string, Active boolean, SortOrder int",
    "Employee": "EmployeeID bigint, DistrictID int, UnitID bigint, RankID int, DesignationID int, KGID string, FirstName string, EmployeeDOB date, GenderID int, BloodGroupID int, PhysicallyChallenged boolean, AppointmentDate date",
    "CaseCategory": "CaseCategoryID int, LookupValue string",
    "GravityOffence": "GravityOffenceID int, LookupValue string",
    "CrimeHead": "CrimeHeadID int, CrimeGroupName string, Active boolean",
    "CrimeSubHead": "CrimeSubHeadID int, CrimeHeadID int, CrimeHeadName string, SeqID int",
    "CaseStatusMaster": "CaseStatusID int, CaseStatusName string",
    "Court": "CourtID int, CourtName string, DistrictID int, StateID int, Active boolean",
    "CaseMaster": "CaseMasterID bigint, CrimeNo string, CaseNo string, CrimeRegisteredDate date, PolicePersonID bigint, PoliceStationID bigint, CaseCategoryID int, GravityOffenceID int, CrimeMajorHeadID int, CrimeMinorHeadID int, CaseStatusID int, CourtID int, IncidentFromDate timestamp_ntz, IncidentToDate timestamp_ntz, InfoReceivedPSDate timestamp_ntz, latitude decimal(9,6), longitude decimal(9,6), BriefFacts string, BriefFactsEmbedding array<float>",
    "Victim": "VictimMasterID bigint, CaseMasterID bigint, VictimName string, AgeYear int, GenderID int, VictimPolice string",
    "Accused": "AccusedMasterID bigint, CaseMasterID bigint, AccusedName string, AgeYear int, GenderID int, PersonID string",
    "Act": "ActCode string, ActDescription string, ShortName string, Active boolean",
    "Section": "ActCode string, SectionCode string, SectionDescription string, Active boolean",
    "CrimeHeadActSection": "CrimeHeadID int, ActCode string, SectionCode string",
    "ActSectionAssociation": "CaseMasterID bigint, ActCode string, SectionCode string, ActOrderID int, SectionOrderID int",
    "OccupationMaster": "OccupationID int, OccupationName string",
    "ReligionMaster": "ReligionID int, ReligionName string",
    "CasteMaster": "caste_master_id int, caste_master_name string",
    "ComplainantDetails": "ComplainantID bigint, CaseMasterID bigint, ComplainantName string, AgeYear int, OccupationID int, ReligionID int, CasteID int, GenderID int",
    "ArrestSurrender": "ArrestSurrenderID bigint, CaseMasterID bigint, ArrestSurrenderTypeID int, ArrestSurrenderDate date, ArrestSurrenderStateId int, ArrestSurrenderDistrictId int, PoliceStationID bigint, IOID bigint, CourtID int, AccusedMasterID bigint, IsAccused boolean, IsComplainantAccused boolean",
    "ChargesheetDetails": "CSID bigint, CaseMasterID bigint, csdate timestamp_ntz, cstype string, PolicePersonID bigint",
}

# How star-schema tables stand in for case tables: (table, condition, expressions in SQL that Spark and DuckDB share).
STAR = {
    "State": ("region", None, ["r_regionkey AS StateID", "r_name AS StateName"]),
    "District": ("nation", None, ["n_nationkey AS DistrictID", "n_name AS DistrictName", "n_regionkey AS StateID"]),
    "Unit": ("customer", None, ["c_custkey AS UnitID", "c_name AS UnitName", "c_nationkey AS DistrictID"]),
    "Employee": ("supplier", None, ["s_suppkey AS EmployeeID", "s_name AS FirstName", "s_nationkey AS DistrictID"]),
    "CaseMaster": (
        "orders",
        None,
        [
            "o_orderkey AS CaseMasterID",
            "concat('1', lpad(CAST(o_custkey AS STRING), 8, '0'), lpad(CAST(o_orderkey AS STRING), 10, '0')) AS CrimeNo",
            "lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0') AS CaseNo",
            "CAST(o_orderdate AS DATE) AS CrimeRegisteredDate",
            "o_orderkey % 10 AS PolicePersonID",
            "o_custkey AS PoliceStationID",
            "CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS CaseCategoryID",
            "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 2 END AS GravityOffenceID",
            "CAST(substring(o_orderpriority, 1, 1) AS INT) AS CrimeMajorHeadID",
            "CAST(substring(o_orderpriority, 1, 1) AS INT) * 10 + CAST(o_orderkey % 3 AS INT) AS CrimeMinorHeadID",
            "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS CaseStatusID",
            "CAST(o_orderkey % 5 AS INT) AS CourtID",
            "CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_custkey % 100 AS DOUBLE) END AS latitude",
            "CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderkey % 100 AS DOUBLE) END AS longitude",
            "concat(o_orderpriority, ' case reported at station ', CAST(o_custkey AS STRING)) AS BriefFacts",
        ],
    ),
    "Accused": (
        "lineitem",
        None,
        ["l_orderkey * 10 + l_linenumber AS AccusedMasterID", "l_orderkey AS CaseMasterID", "concat('Person ', CAST(l_partkey AS STRING)) AS AccusedName", "CAST(l_quantity AS INT) + 10 AS AgeYear", "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS GenderID", "CAST(l_partkey AS STRING) AS PersonID"],
    ),
    "Victim": ("orders", None, ["o_orderkey AS VictimMasterID", "o_orderkey AS CaseMasterID", "concat('Victim ', CAST(o_orderkey AS STRING)) AS VictimName", "CAST(o_orderkey % 80 AS INT) AS AgeYear", "CAST(o_orderkey % 4 AS INT) AS GenderID"]),
    "ComplainantDetails": ("orders", None, ["o_orderkey AS ComplainantID", "o_orderkey AS CaseMasterID", "CAST(o_orderkey % 15 AS INT) AS OccupationID", "CAST(o_custkey % 6 AS INT) AS ReligionID", "CAST((o_orderkey + o_custkey) % 14 AS INT) AS CasteID"]),
    "ActSectionAssociation": ("lineitem", None, ["l_orderkey AS CaseMasterID", "l_returnflag AS ActCode", "l_linestatus AS SectionCode", "l_linenumber AS ActOrderID"]),
    "ArrestSurrender": (
        "lineitem",
        "l_returnflag = 'R'",
        ["l_orderkey * 10 + l_linenumber AS ArrestSurrenderID", "l_orderkey AS CaseMasterID", "CAST(l_shipdate AS DATE) AS ArrestSurrenderDate", "CAST(l_suppkey % 25 AS INT) AS ArrestSurrenderDistrictId", "l_orderkey * 10 + l_linenumber AS AccusedMasterID"],
    ),
    "ChargesheetDetails": ("orders", "o_orderstatus = 'F'", ["o_orderkey AS CSID", "o_orderkey AS CaseMasterID", "o_orderdate AS csdate", "CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS cstype", "o_orderkey % 10 AS PolicePersonID"]),
}

#: Lookup rows beside the star-schema tables.
LOOKUPS = {
    "CaseCategory": (["CaseCategoryID", "LookupValue"], [(1, "FIR"), (2, "Petition")]),
    "GravityOffence": (["GravityOffenceID", "LookupValue"], [(1, "Heinous"), (2, "Non-Heinous")]),
    "CrimeHead": (["CrimeHeadID", "CrimeGroupName"], [(1, "1-URGENT"), (2, "2-HIGH"), (3, "3-MEDIUM"), (4, "4-NOT SPECIFIED"), (5, "5-LOW")]),
    "CrimeSubHead": (["CrimeSubHeadID", "CrimeHeadID", "CrimeHeadName"], [(10 * h + s, h, f"Sub-head {h}.{s}") for h in range(1, 6) for s in range(3)]),
    "CaseStatusMaster": (["CaseStatusID", "CaseStatusName"], [(1, "Closed"), (2, "Under Investigation"), (3, "Charge Sheeted")]),
    "Court": (["CourtID", "CourtName"], [(k, f"Court {k}") for k in range(5)]),
    "OccupationMaster": (["OccupationID", "OccupationName"], [(k, f"Occupation {k}") for k in range(15)]),
    "ReligionMaster": (["ReligionID", "ReligionName"], [(k, f"Religion {k}") for k in range(6)]),
    "CasteMaster": (["caste_master_id", "caste_master_name"], [(k, f"Caste {k}") for k in range(14)]),
    "Section": (["ActCode", "SectionCode", "SectionDescription"], [(a, s, f"Section {a}{s}") for a in "AR" for s in "FO"]),
}


class Tables:
    """Case tables by name: DataFrames, or functions that make them when they are first asked for."""

    def __init__(self, tables: dict[str, DataFrame] | dict[str, Callable[[], DataFrame]]):
        self.tables = dict(tables)

    def __getitem__(self, name: str) -> DataFrame:
        found = self.tables[name]
        if not isinstance(found, DataFrame):
            found = self.tables[name] = found()
        return found

    def __iter__(self) -> Iterator[str]:
        return iter(list(self.tables))

    def register(self) -> None:
        """Temporary views of the tables' names, for SQL."""
        for name in self:
            self[name].createOrReplaceTempView(name)


def from_folder(spark: SparkSession, folder: str) -> Tables:
    """Tables from ``folder/<name>`` in Parquet, with the declared schemas; tables that aren't there are empty."""
    found = {}
    for name, ddl in SCHEMAS.items():
        try:
            found[name] = spark.read.schema(ddl).parquet(f"{folder}/{name}")
        except AnalysisException:
            found[name] = spark.createDataFrame([], ddl)
    return Tables(found)


def from_star(spark: SparkSession, folder: str) -> Tables:
    """Case tables over star-schema Parquet files (region, nation, customer, supplier, orders, lineitem)."""

    def facts(source: str, condition: str | None, columns: list[str]) -> DataFrame:
        df = spark.read.parquet(f"{folder}/{source}.parquet")
        return (df.where(condition) if condition else df).selectExpr(*columns)

    found = {name: partial(facts, *how) for name, how in STAR.items()}
    return Tables(found | {name: partial(spark.createDataFrame, rows, columns) for name, (columns, rows) in LOOKUPS.items()})


def star_sql(*names: str) -> str:
    """The same tables as a WITH clause, for an oracle on star-schema tables."""
    parts = []
    for name in names:
        if name in STAR:
            source, condition, columns = STAR[name]
            parts.append(f"{name} AS (SELECT {', '.join(columns)} FROM {source}{f' WHERE {condition}' if condition else ''})")
        else:
            columns, rows = LOOKUPS[name]
            listed = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
            parts.append(f"{name}({', '.join(columns)}) AS (VALUES {listed})")
    return "WITH " + ",\n".join(parts) + "\n"
