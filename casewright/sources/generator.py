"""Synthetic case tables of any size, the same for the same seed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.columns import padded
from casewright.sources.tables import SCHEMAS, Tables

# The crime groups of the sample data with their weights, and whether a group is heinous.
GROUPS = {
    "Crimes Against Body": (20, True),
    "Crimes Against Property": (35, False),
    "Crimes Against Women": (15, True),
    "Cybercrimes": (10, False),
    "Economic Offences": (8, False),
    "Road Accidents": (7, False),
    "Narcotics": (3, False),
    "Other IPC Crimes": (2, False),
}
STATUSES = ["Under Investigation", "Charge Sheeted", "Closed", "False Case"]
DISTRICTS, UNITS_EACH, DAYS = 30, 7, 720


def _uniform(salt: int, seed: int, *keys: Column | str) -> Column:
    """A number in 0 ... 1 that depends on keys and seed alone, not on partitions."""
    return F.pmod(F.xxhash64(*keys, F.lit(salt), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _below(n: Column | int, salt: int, seed: int, *keys: Column | str) -> Column:
    return F.floor(_uniform(salt, seed, *keys) * (F.lit(n) if isinstance(n, int) else n)).cast("int")


def _weighted(weights: list[int], salt: int, seed: int, *keys: Column | str) -> Column:
    """1 for the first weight's share, 2 for the second's, and so on."""
    draw, total, acc = _uniform(salt, seed, *keys) * sum(weights), 0, F.lit(len(weights))
    for k in reversed(range(len(weights))):
        total = sum(weights[: k + 1])
        acc = F.when(draw < total, k + 1).otherwise(acc)
    return acc


def generate(spark: SparkSession, cases: int, until: date, seed: int = 0, persons: int = 5000, crew: int = 900, parts: int | None = None) -> Tables:
    """Cases up to the day ``until`` with accused (one to three, of a pool of persons, some in crews of six), victims, arrests,
    chargesheets and sections. Each row is a function of its number and the seed, so any part can be made again alone."""
    ids = spark.range(1, cases + 1, numPartitions=parts).select(F.col("id").alias("CaseMasterID"))
    k = "CaseMasterID"
    heinous = [i + 1 for i, (_, h) in enumerate(GROUPS.values()) if h]
    drawn = ids.select(
        k,
        F.date_sub(F.lit(until), _below(DAYS, 1, seed, k)).alias("CrimeRegisteredDate"),
        (_below(DISTRICTS * UNITS_EACH, 2, seed, k) + 1).cast("bigint").alias("PoliceStationID"),
        _weighted([w for w, _ in GROUPS.values()], 3, seed, k).alias("CrimeMajorHeadID"),
        (_below(DISTRICTS * 10, 4, seed, k) + 1).cast("bigint").alias("PolicePersonID"),
        _weighted([60, 25, 10, 5], 5, seed, k).alias("CaseStatusID"),
    )
    number = F.concat(F.lit("1"), padded(F.col("PoliceStationID"), 4), padded(F.col("PoliceStationID"), 4), F.year("CrimeRegisteredDate").cast("string"), padded(F.col(k), 5))
    master = drawn.select(
        "*",
        number.alias("CrimeNo"),
        padded(F.col(k) % 100000, 5).alias("CaseNo"),
        F.lit(1).alias("CaseCategoryID"),
        F.when(F.col("CrimeMajorHeadID").isin(heinous), 1).otherwise(2).alias("GravityOffenceID"),
        (F.col("CrimeMajorHeadID") * 10 + _below(2, 6, seed, k)).alias("CrimeMinorHeadID"),
        (_below(5, 7, seed, k) + 1).alias("CourtID"),
        (F.lit(12.0) + _uniform(8, seed, k)).cast("decimal(9,6)").alias("latitude"),
        (F.lit(76.0) + _uniform(9, seed, k)).cast("decimal(9,6)").alias("longitude"),
        F.concat(F.lit("Case of kind "), F.col("CrimeMajorHeadID").cast("string"), F.lit(" reported at station "), F.col("PoliceStationID").cast("string")).alias("BriefFacts"),
    )
    # crews: a case may take all its accused from one crew of six
    in_crew, own_crew = _uniform(10, seed, k) < 0.12, _below(crew // 6, 11, seed, k)
    places = drawn.select(k, F.explode(F.sequence(F.lit(1), _below(3, 12, seed, k) + 1)).alias("place"), in_crew.alias("in_crew"), own_crew.alias("own"))
    person = F.when(F.col("in_crew"), F.col("own") * 6 + F.pmod(F.col("place") + _below(6, 13, seed, k), F.lit(6))).otherwise(_below(persons, 14, seed, k, "place"))
    accused = places.select((F.col(k) * 4 + F.col("place")).alias("AccusedMasterID"), k, person.alias("p")).select("AccusedMasterID", k, F.concat(F.lit("Person "), F.col("p").cast("string")).alias("AccusedName"), (18 + _below(50, 15, seed, "p")).alias("AgeYear"), _weighted([80, 18, 2], 16, seed, "p").alias("GenderID"), F.concat(F.lit("P"), padded(F.col("p"), 6)).alias("PersonID"))
    accused = accused.dropDuplicates([k, "PersonID"])
    victims = ids.select(F.col(k).alias("VictimMasterID"), k, F.concat(F.lit("Victim "), F.col(k).cast("string")).alias("VictimName"), (15 + _below(60, 17, seed, k)).alias("AgeYear"), _weighted([50, 48, 2], 18, seed, k).alias("GenderID"))
    complainants = ids.select(F.col(k).alias("ComplainantID"), k, F.concat(F.lit("Complainant "), F.col(k).cast("string")).alias("ComplainantName"), (18 + _below(60, 19, seed, k)).alias("AgeYear"), (_below(15, 20, seed, k) + 1).alias("OccupationID"), (_below(6, 21, seed, k) + 1).alias("ReligionID"), (_below(14, 22, seed, k) + 1).alias("CasteID"), _weighted([60, 40], 23, seed, k).alias("GenderID"))
    sections = ids.select(k, F.lit("ACT1").alias("ActCode"), (_below(9, 24, seed, k) + 1).cast("string").alias("SectionCode"), F.lit(1).alias("ActOrderID"), F.lit(1).alias("SectionOrderID"))
    chance = F.when(F.col("CrimeMajorHeadID").isin(heinous), 0.42).otherwise(0.28)
    arrests = drawn.filter(_uniform(25, seed, k) < chance).select(F.col(k).alias("ArrestSurrenderID"), k, F.date_add("CrimeRegisteredDate", _below(31, 26, seed, k)).alias("ArrestSurrenderDate"), ((F.col("PoliceStationID") - 1) % DISTRICTS + 1).cast("int").alias("ArrestSurrenderDistrictId"), (F.col(k) * 4 + 1).alias("AccusedMasterID"))
    sheets = drawn.filter(F.col("CaseStatusID") == 2).select(F.col(k).alias("CSID"), k, F.date_add("CrimeRegisteredDate", _below(91, 27, seed, k)).cast("timestamp_ntz").alias("csdate"), F.lit("A").alias("cstype"), "PolicePersonID")
    made = {"CaseMaster": master, "Accused": accused, "Victim": victims, "ComplainantDetails": complainants, "ActSectionAssociation": sections, "ArrestSurrender": arrests, "ChargesheetDetails": sheets}
    small = {
        "State": [(1, "State 1", 1, True)],
        "District": [(d, f"District {d}", 1, True) for d in range(1, DISTRICTS + 1)],
        "Unit": [(u, f"Station {u}", 1, None, 1, 1, (u - 1) % DISTRICTS + 1, True) for u in range(1, DISTRICTS * UNITS_EACH + 1)],
        "Employee": [(e, (e - 1) % DISTRICTS + 1, e % (DISTRICTS * UNITS_EACH) + 1, 1, 1, f"K{e:05d}", f"Officer {e}", None, 1, 1, False, None) for e in range(1, DISTRICTS * 10 + 1)],
        "CaseCategory": [(1, "FIR"), (2, "Petition")],
        "GravityOffence": [(1, "Heinous"), (2, "Non-Heinous")],
        "CrimeHead": [(i, name, True) for i, name in enumerate(GROUPS, 1)],
        "CrimeSubHead": [(10 * i + s, i, f"{name} {s}", s) for i, name in enumerate(GROUPS, 1) for s in range(2)],
        "CaseStatusMaster": list(enumerate(STATUSES, 1)),
        "Court": [(c, f"Court {c}", c, 1, True) for c in range(1, 6)],
        "Act": [("ACT1", "Act 1", "A1", True)],
        "Section": [("ACT1", str(s), f"Section {s}", True) for s in range(1, 10)],
        "OccupationMaster": [(o, f"Occupation {o}") for o in range(1, 16)],
        "ReligionMaster": [(r, f"Religion {r}") for r in range(1, 7)],
        "CasteMaster": [(c, f"Caste {c}") for c in range(1, 15)],
    }
    tables: dict[str, DataFrame] = {}
    for name, ddl in SCHEMAS.items():
        empty = spark.createDataFrame(small.get(name, []), ddl)
        tables[name] = empty if name not in made else made[name].select(*[(F.col(f.name) if f.name in made[name].columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])
    return Tables(tables)


def write(tables: Tables, folder: str) -> None:
    """Replace the tables in ``folder``; cases are sorted by date within files, so that scans of recent ones skip the rest."""
    for name in tables:
        df = tables[name]
        (df.sortWithinPartitions("CrimeRegisteredDate") if name == "CaseMaster" else df).write.mode("overwrite").parquet(f"{folder}/{name}")
