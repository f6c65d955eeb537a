"""The library's queries over star-schema tables, and the same results in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators import cases, filters, forecast, insights, network, profile, retrieval, risk, upkeep
from casewright.plans import corpus
from casewright.sources.tables import Tables, from_star, star_sql

AS_OF, MONTH_END = "2001-08-01 00:00:00", "2001-07-31 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
DISTRICT, GROUP, SUBHEAD = "NATION_3", "2-HIGH", "Sub-head 2.1"
WORDS = "the and that with this"
Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}


def _add(name: str, build: Callable[[Tables], DataFrame], tables: str, sql: str) -> None:
    QUERIES[name] = lambda spark, folder: build(from_star(spark, folder))
    SQL[name] = (star_sql(*tables.split()) + sql) if tables else sql


def _example(key: str, build: Callable, tables: str, sql: str, **parameters: object) -> None:
    _add(key, partial(build, as_of=MONTH_END, **parameters), tables, sql)


_GEO = "JOIN Unit u ON u.UnitID = cm.PoliceStationID JOIN District d ON d.DistrictID = u.DistrictID"
_HEAD = "JOIN CrimeHead ch ON ch.CrimeHeadID = cm.CrimeMajorHeadID"
_SUB = "JOIN CrimeSubHead csh ON csh.CrimeSubHeadID = cm.CrimeMinorHeadID"
_STATUS = "JOIN CaseStatusMaster cs ON cs.CaseStatusID = cm.CaseStatusID"
_D, _LATEST = "cm.CrimeRegisteredDate", "ORDER BY cm.CrimeRegisteredDate DESC NULLS FIRST, cm.CaseMasterID LIMIT 200"
_YEAR = f"{_D} >= date_trunc('year', TIMESTAMP '{MONTH_END}')"
_NOW = f"TIMESTAMP '{MONTH_END}'"

_add("district_counts", cases.district_counts, "CaseMaster Unit District", f"SELECT d.DistrictName AS name, count(*) AS count FROM CaseMaster cm {_GEO} GROUP BY 1")
_example("qx00_district_cases", corpus.qx00_district_cases, "CaseMaster Unit District CrimeHead CrimeSubHead CaseStatusMaster", f"SELECT cm.CaseMasterID, cm.CrimeNo, {_D}, u.UnitName, ch.CrimeGroupName, csh.CrimeHeadName, cs.CaseStatusName FROM CaseMaster cm {_GEO} {_HEAD} {_SUB} {_STATUS} WHERE d.DistrictName = '{DISTRICT}' AND {_D} >= {_NOW} - INTERVAL '6 months' {_LATEST}", district=DISTRICT)
_example("qx01_group_by_district", corpus.qx01_group_by_district, "CaseMaster Unit District CrimeHead", f"SELECT d.DistrictName, count(*) AS total_cases FROM CaseMaster cm {_GEO} {_HEAD} WHERE ch.CrimeGroupName = '{GROUP}' AND {_YEAR} GROUP BY 1", group=GROUP)
_example("qx02_monthly_trend", corpus.qx02_monthly_trend, "CaseMaster CrimeHead", f"SELECT date_trunc('month', {_D})::TIMESTAMP AS month, count(*) AS cases FROM CaseMaster cm {_HEAD} WHERE ch.CrimeGroupName = '{GROUP}' GROUP BY 1", group=GROUP)
_example("qx03_repeat_accused", corpus.qx03_repeat_accused, "CaseMaster Accused", f"SELECT a.AccusedName, a.AgeYear, count(DISTINCT a.CaseMasterID) AS case_count FROM Accused a JOIN CaseMaster cm ON cm.CaseMasterID = a.CaseMasterID WHERE {_D} >= {_NOW} - INTERVAL '700 days' GROUP BY 1, 2 HAVING count(DISTINCT a.CaseMasterID) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 50", days=700, more_than=1)
_example("qx04_district_arrests", corpus.qx04_district_arrests, "ArrestSurrender District", f"SELECT d.DistrictName, count(*) AS total_arrests FROM ArrestSurrender ar JOIN District d ON d.DistrictID = ar.ArrestSurrenderDistrictId WHERE d.DistrictName = '{DISTRICT}' AND ar.ArrestSurrenderDate >= date_trunc('month', {_NOW} - INTERVAL '1 month') AND ar.ArrestSurrenderDate < date_trunc('month', {_NOW}) GROUP BY 1", district=DISTRICT)
_example("qx05_open_cases", corpus.qx05_open_cases, "CaseMaster Unit District CrimeHead CrimeSubHead CaseStatusMaster", f"SELECT cm.CaseMasterID, cm.CrimeNo, {_D}, u.UnitName, ch.CrimeGroupName, csh.CrimeHeadName FROM CaseMaster cm {_GEO} {_HEAD} {_SUB} {_STATUS} WHERE d.DistrictName = '{DISTRICT}' AND cs.CaseStatusName = 'Under Investigation' {_LATEST}", district=DISTRICT)
_example("qx06_top_groups", corpus.qx06_top_groups, "CaseMaster CrimeHead", f"SELECT ch.CrimeGroupName, count(*) AS total_cases FROM CaseMaster cm {_HEAD} WHERE {_YEAR} GROUP BY 1")
_example("qx07_female_victims", corpus.qx07_female_victims, "Victim CaseMaster CrimeHead Unit District", f"SELECT cm.CaseMasterID, {_D}, v.VictimName, v.AgeYear, ch.CrimeGroupName, d.DistrictName FROM Victim v JOIN CaseMaster cm ON cm.CaseMasterID = v.CaseMasterID {_HEAD} {_GEO} WHERE v.GenderID = 2 AND {_D} >= {_NOW} - INTERVAL '12 months' {_LATEST}")
_example("qx08_busiest_officers", corpus.qx08_busiest_officers, "CaseMaster Employee District", f"SELECT e.FirstName, count(cm.CaseMasterID) AS total_cases, d.DistrictName FROM CaseMaster cm JOIN Employee e ON e.EmployeeID = cm.PolicePersonID JOIN District d ON d.DistrictID = e.DistrictID WHERE {_YEAR} GROUP BY e.EmployeeID, e.FirstName, d.DistrictName ORDER BY 2 DESC, e.EmployeeID LIMIT 20")
_example("qx09_cases_of_accused", corpus.qx09_cases_of_accused, "Accused CaseMaster Unit District CrimeHead CrimeSubHead CaseStatusMaster", f"SELECT cm.CaseMasterID, cm.CrimeNo, {_D}, u.UnitName, d.DistrictName, ch.CrimeGroupName, csh.CrimeHeadName, cs.CaseStatusName FROM Accused a JOIN CaseMaster cm ON cm.CaseMasterID = a.CaseMasterID {_GEO} {_HEAD} {_SUB} {_STATUS} WHERE a.AccusedName ILIKE '%PERSON 12%' AND {_D} >= {_NOW} - INTERVAL '30 days' ORDER BY {_D} DESC NULLS FIRST, cm.CaseMasterID, a.AccusedMasterID, a.AccusedName LIMIT 200", person="PERSON 12")
_example("qx10_points", corpus.qx10_points, "CaseMaster Unit District CrimeSubHead CaseStatusMaster", f"SELECT cm.CaseMasterID, {_D}, cm.latitude, cm.longitude, u.UnitName, cs.CaseStatusName FROM CaseMaster cm {_GEO} {_SUB} {_STATUS} WHERE d.DistrictName = '{DISTRICT}' AND csh.CrimeHeadName = '{SUBHEAD}' AND cm.latitude IS NOT NULL", district=DISTRICT, subhead=SUBHEAD)
_example("qx11_subhead_count", corpus.qx11_subhead_count, "CaseMaster CrimeSubHead", f"SELECT count(*) AS murder_cases FROM CaseMaster cm {_SUB} WHERE csh.CrimeHeadName = '{SUBHEAD}' AND {_YEAR}", subhead=SUBHEAD)
_example("qx12_chargesheets", corpus.qx12_chargesheets, "ChargesheetDetails CaseMaster Unit District CrimeHead", f"SELECT cd.CSID, cm.CaseMasterID, cm.CrimeNo, cd.csdate, u.UnitName, d.DistrictName, ch.CrimeGroupName FROM ChargesheetDetails cd JOIN CaseMaster cm ON cm.CaseMasterID = cd.CaseMasterID {_GEO} {_HEAD} WHERE cd.cstype = 'A' AND cd.csdate >= date_trunc('month', {_NOW}) ORDER BY cd.csdate DESC, cd.CSID LIMIT 200")
_example("qx13_status_by_district", corpus.qx13_status_by_district, "CaseMaster Unit District CaseStatusMaster", f"SELECT d.DistrictName, count(*) AS false_cases FROM CaseMaster cm {_STATUS} {_GEO} WHERE cs.CaseStatusName = 'Charge Sheeted' GROUP BY 1", status="Charge Sheeted")
for _name, _build, _when, _columns in (
    ("qx14_group_this_year", corpus.qx14_group_this_year, _YEAR, ", cs.CaseStatusName"),
    ("qx15_group_without_status", corpus.qx15_group_without_status, _YEAR, ""),
    ("qx16_group_three_months", corpus.qx16_group_three_months, f"{_D} >= {_NOW} - INTERVAL '3 months'", ", cs.CaseStatusName"),
):
    _example(_name, _build, "CaseMaster CrimeHead CrimeSubHead Unit District CaseStatusMaster", f"SELECT cm.CaseMasterID, cm.CrimeNo, {_D}, u.UnitName, d.DistrictName, csh.CrimeHeadName{_columns} FROM CaseMaster cm {_HEAD} {_SUB} {_GEO} {_STATUS if _columns else ''} WHERE ch.CrimeGroupName = '{GROUP}' AND {_when} {_LATEST}", group=GROUP)
_example("qx17_subhead_six_months", corpus.qx17_subhead_six_months, "CaseMaster CrimeSubHead Unit District CaseStatusMaster", f"SELECT cm.CaseMasterID, cm.CrimeNo, {_D}, u.UnitName, d.DistrictName, cs.CaseStatusName FROM CaseMaster cm {_SUB} {_GEO} {_STATUS} WHERE csh.CrimeHeadName = '{SUBHEAD}' AND {_D} >= {_NOW} - INTERVAL '6 months' {_LATEST}", subhead=SUBHEAD)
_example("qx18_minor_victims", corpus.qx18_minor_victims, "Victim CaseMaster CrimeHead Unit District", f"SELECT v.VictimName, v.AgeYear, cm.CaseMasterID, {_D}, ch.CrimeGroupName, d.DistrictName FROM Victim v JOIN CaseMaster cm ON cm.CaseMasterID = v.CaseMasterID {_HEAD} {_GEO} WHERE v.AgeYear < 18 AND {_YEAR} {_LATEST}")
_example("qx19_category_by_district", corpus.qx19_category_by_district, "CaseMaster Unit District CaseCategory", f"SELECT d.DistrictName, count(*) AS total_firs FROM CaseMaster cm {_GEO} JOIN CaseCategory cc ON cc.CaseCategoryID = cm.CaseCategoryID WHERE cc.LookupValue = 'FIR' AND {_YEAR} GROUP BY 1")
_example("qx20_heinous_count", corpus.qx20_heinous_count, "CaseMaster GravityOffence Unit District", f"SELECT count(*) AS heinous_crimes FROM CaseMaster cm JOIN GravityOffence g ON g.GravityOffenceID = cm.GravityOffenceID {_GEO} WHERE g.LookupValue = 'Heinous' AND d.DistrictName = '{DISTRICT}' AND {_YEAR}", district=DISTRICT)
_example("qx21_section_cases", corpus.qx21_section_cases, "CaseMaster ActSectionAssociation Unit District CaseStatusMaster", f"SELECT cm.CaseMasterID, cm.CrimeNo, {_D}, u.UnitName, d.DistrictName, cs.CaseStatusName FROM CaseMaster cm JOIN ActSectionAssociation asa ON asa.CaseMasterID = cm.CaseMasterID {_GEO} {_STATUS} WHERE asa.ActCode = 'A' AND asa.SectionCode = 'F' {_LATEST}", act="A", section="F")
_example("qx22_busiest_stations", corpus.qx22_busiest_stations, "CaseMaster CrimeHead Unit District", f"SELECT u.UnitName, d.DistrictName, count(*) AS cybercrime_cases FROM CaseMaster cm {_HEAD} {_GEO} WHERE ch.CrimeGroupName = '{GROUP}' AND {_YEAR} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20", group=GROUP)
_example("qx23_young_men", corpus.qx23_young_men, "Accused CaseMaster CrimeHead Unit District", f"SELECT a.AccusedName, a.AgeYear, cm.CaseMasterID, {_D}, ch.CrimeGroupName, d.DistrictName FROM Accused a JOIN CaseMaster cm ON cm.CaseMasterID = a.CaseMasterID {_HEAD} {_GEO} WHERE a.GenderID = 1 AND a.AgeYear < 25 AND {_D} >= date_trunc('month', {_NOW} - INTERVAL '1 month') AND {_D} < date_trunc('month', {_NOW}) ORDER BY {_D} DESC NULLS FIRST, cm.CaseMasterID, a.AccusedMasterID, a.AccusedName LIMIT 200")
_example("qx24_closed_by_district", corpus.qx24_closed_by_district, "CaseMaster CaseStatusMaster Unit District", f"SELECT d.DistrictName, count(*) AS closed_cases FROM CaseMaster cm {_STATUS} {_GEO} WHERE cs.CaseStatusName = 'Closed' AND {_YEAR} GROUP BY 1")
_example("qx25_age_bands", corpus.qx25_age_bands, "Accused CaseMaster CrimeHead", f"SELECT CASE WHEN a.AgeYear < 26 THEN '18-25' WHEN a.AgeYear < 36 THEN '26-35' WHEN a.AgeYear < 46 THEN '36-45' ELSE '46+' END AS age_band, count(*) AS accused FROM Accused a JOIN CaseMaster cm ON cm.CaseMasterID = a.CaseMasterID {_HEAD} WHERE ch.CrimeGroupName = '{GROUP}' AND a.AgeYear IS NOT NULL GROUP BY 1", group=GROUP)
_example("qx26_victim_gender", corpus.qx26_victim_gender, "Victim CaseMaster CrimeSubHead", f"SELECT CASE v.GenderID WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Other' END AS gender, count(*) AS victims FROM Victim v JOIN CaseMaster cm ON cm.CaseMasterID = v.CaseMasterID {_SUB} WHERE csh.CrimeHeadName = '{SUBHEAD}' AND v.GenderID IS NOT NULL GROUP BY 1", subhead=SUBHEAD)
_example("qx27_occupations", corpus.qx27_occupations, "ComplainantDetails CaseMaster CrimeHead OccupationMaster", f"SELECT om.OccupationName, count(*) AS complainants FROM ComplainantDetails cd JOIN CaseMaster cm ON cm.CaseMasterID = cd.CaseMasterID {_HEAD} JOIN OccupationMaster om ON om.OccupationID = cd.OccupationID WHERE ch.CrimeGroupName = '{GROUP}' GROUP BY 1", group=GROUP)
_example("qx28_average_age", corpus.qx28_average_age, "Accused CaseMaster CrimeHead", f"SELECT ch.CrimeGroupName, round(avg(a.AgeYear)) AS avg_age, count(*) AS accused FROM Accused a JOIN CaseMaster cm ON cm.CaseMasterID = a.CaseMasterID {_HEAD} WHERE a.AgeYear IS NOT NULL GROUP BY 1")
_example("qx29_religions", corpus.qx29_religions, "ComplainantDetails CaseMaster Unit District ReligionMaster", f"SELECT rm.ReligionName, count(*) AS complainants FROM ComplainantDetails cd JOIN CaseMaster cm ON cm.CaseMasterID = cd.CaseMasterID {_GEO} JOIN ReligionMaster rm ON rm.ReligionID = cd.ReligionID WHERE d.DistrictName = '{DISTRICT}' GROUP BY 1", district=DISTRICT)
_example("qx30_rising_districts", corpus.qx30_rising_districts, "CaseMaster Unit District", f"SELECT * FROM (SELECT d.DistrictName, count(*) FILTER (WHERE {_D} >= date_trunc('month', {_NOW})) AS this_month, count(*) FILTER (WHERE {_D} >= date_trunc('month', {_NOW} - INTERVAL '1 month') AND {_D} < date_trunc('month', {_NOW})) AS last_month FROM CaseMaster cm {_GEO} GROUP BY 1) WHERE this_month > last_month")
_example("chargesheet_rate", corpus.chargesheet_rate, "CaseMaster ChargesheetDetails CrimeHead", f"SELECT ch.CrimeGroupName, count(*) AS cases, round(100.0 * count(*) FILTER (WHERE EXISTS (SELECT 1 FROM ChargesheetDetails s WHERE s.CaseMasterID = cm.CaseMasterID)) / count(*))::DOUBLE AS rate FROM CaseMaster cm {_HEAD} GROUP BY 1")
_example("days_to_chargesheet", corpus.days_to_chargesheet, "CaseMaster ChargesheetDetails Unit District", f"SELECT d.DistrictName, round(avg(date_diff('day', {_D}, f.filed::DATE)), 1) AS avg_days, count(*) AS cases FROM CaseMaster cm JOIN (SELECT CaseMasterID, min(csdate) AS filed FROM ChargesheetDetails GROUP BY 1) f ON f.CaseMasterID = cm.CaseMasterID {_GEO} GROUP BY 1")
_example("accused_in_several_districts", corpus.accused_in_several_districts, "Accused CaseMaster Unit District", f"SELECT a.PersonID, count(DISTINCT d.DistrictName) AS districts FROM Accused a JOIN CaseMaster cm ON cm.CaseMasterID = a.CaseMasterID {_GEO} WHERE a.PersonID IS NOT NULL GROUP BY 1 HAVING count(DISTINCT d.DistrictName) >= 2 ORDER BY 2 DESC, 1 LIMIT 50")

# insights
_A = f"TIMESTAMP '{AS_OF}'"
_SPIKES = f"""SELECT district_name, this_month, last_month, floor((this_month - last_month) / last_month * 100 + 0.5)::BIGINT AS pct FROM (
  SELECT d.DistrictName AS district_name,
         count(*) FILTER (WHERE {_D} >= date_trunc('month', {_A} - INTERVAL '1 month') AND {_D} < date_trunc('month', {_A})) AS this_month,
         count(*) FILTER (WHERE {_D} >= date_trunc('month', {_A} - INTERVAL '2 months') AND {_D} < date_trunc('month', {_A} - INTERVAL '1 month')) AS last_month
  FROM CaseMaster cm {_GEO} GROUP BY 1) WHERE last_month > 5 AND this_month > last_month * 1.15 ORDER BY this_month DESC, district_name LIMIT 3"""
_REPEAT = f"""SELECT a.AccusedName AS accused_name, count(DISTINCT a.CaseMasterID) AS case_count, string_agg(DISTINCT ch.CrimeGroupName, ', ' ORDER BY ch.CrimeGroupName) AS crime_types
  FROM Accused a JOIN CaseMaster cm ON cm.CaseMasterID = a.CaseMasterID {_HEAD}
  WHERE {_D} >= {_A} - INTERVAL '365 days' AND a.AccusedName IS NOT NULL GROUP BY 1 HAVING count(DISTINCT a.CaseMasterID) >= 3 ORDER BY 2 DESC, 1 LIMIT 2"""
_SURGE_BASE = f"""SELECT ch.CrimeGroupName AS crime_type, count(*) FILTER (WHERE {_D} >= {_A} - INTERVAL '7 days') AS this_week,
  count(*) FILTER (WHERE {_D} >= {_A} - INTERVAL '14 days' AND {_D} < {_A} - INTERVAL '7 days') AS last_week FROM CaseMaster cm {_HEAD} GROUP BY 1"""
_SURGED = "SELECT *, CASE WHEN last_week > 0 THEN floor((this_week - last_week) / last_week * 100 + 0.5)::BIGINT ELSE 0 END AS pct FROM (SELECT * FROM ({base}) WHERE this_week > 5 ORDER BY this_week DESC, crime_type LIMIT 1) WHERE this_week > last_week * 1.3"


def _forecast_sql(at: str) -> str:
    months = ", ".join(f"count(*) FILTER (WHERE date_trunc('month', {_D}) = date_trunc('month', {at}) - INTERVAL '{5 - k} months') AS y{k}" for k in range(6))
    return f"""SELECT * FROM (SELECT district, crime_group, slope, greatest(0, floor(intercept + slope * 6 + 0.5))::BIGINT AS projected, y5 AS recent, slope + greatest(0, floor(intercept + slope * 6 + 0.5))::BIGINT - y5 AS score FROM (
  SELECT *, (total - slope * 15) / 6 AS intercept FROM (
    SELECT *, (6 * (y1 + 2 * y2 + 3 * y3 + 4 * y4 + 5 * y5) - 15 * total) / 105.0::DOUBLE AS slope FROM (
      SELECT *, y0 + y1 + y2 + y3 + y4 + y5 AS total FROM (SELECT d.DistrictName AS district, ch.CrimeGroupName AS crime_group, {months} FROM CaseMaster cm {_GEO} {_HEAD} GROUP BY 1, 2)
    ) WHERE total >= 12)) WHERE slope > 0.5) WHERE projected > recent ORDER BY score DESC, district, crime_group LIMIT 4"""


_CASES = "CaseMaster Unit District CrimeHead"
_add("insight_spikes", lambda t: insights.spikes(t, AS_OF), "CaseMaster Unit District", _SPIKES)
_add("insight_repeat_accused", lambda t: insights.repeat_accused(t, AS_OF, days=365), "Accused CaseMaster CrimeHead", _REPEAT)
_add("insight_weekly_surge", lambda t: insights.weekly_surge(t, AS_OF), "CaseMaster CrimeHead", _SURGED.format(base=_SURGE_BASE))


def _events_surge(spark: SparkSession, folder: str) -> DataFrame:
    return insights.weekly_counts(spark.read.parquet(f"{folder}/events.parquet"), "event_type", "ts", EVENTS_AS_OF, dates=False)


QUERIES["events_weekly_counts"] = _events_surge
SQL["events_weekly_counts"] = f"SELECT event_type AS crime_type, count(*) FILTER (WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL '7 days') AS this_week, count(*) FILTER (WHERE ts < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL '7 days') AS last_week FROM events WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL '14 days' GROUP BY 1"
_SIX = ("slope", "score")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in _SIX})


_add("insight_forecast", lambda t: _rounded(forecast.forecasts(t, MONTH_END)), _CASES, f"SELECT * REPLACE (round(slope, 6) AS slope, round(score, 6) AS score) FROM ({_forecast_sql(_NOW)})")


def _bundle_sql() -> str:
    return f"""SELECT (1000 + row_number() OVER (ORDER BY this_month DESC, district_name))::INT AS seq, 'spike' AS type, 'Crime spike in ' || district_name AS title, pct || '% jump last month (' || this_month || ' vs ' || last_month || ' the month before)' AS detail, 'Show crime breakdown in ' || district_name || ' for the last 2 months' AS query FROM ({_SPIKES})
UNION ALL SELECT (2000 + row_number() OVER (ORDER BY case_count DESC, accused_name))::INT, 'repeat_suspect', 'Repeat accused: ' || accused_name, 'Linked to ' || case_count || ' cases in last 30 days (' || crime_types || ')', 'Show all cases linked to accused ' || accused_name || ' in the last 30 days' FROM ({_REPEAT.replace("365 days", "30 days")})
UNION ALL SELECT (3000 + row_number() OVER (ORDER BY crime_type))::INT, 'weekly_surge', crime_type || ' surging statewide', pct || '% more ' || crime_type || ' cases this week vs last week', 'Show ' || crime_type || ' hotspots in the last 7 days with map' FROM ({_SURGED.format(base=_SURGE_BASE)})
UNION ALL SELECT (4000 + row_number() OVER (ORDER BY score DESC, district, crime_group))::INT, 'forecast', crime_group || ' rising in ' || district, 'Trending up ~' || format('{{:.1f}}', slope) || '/month · projected ' || projected || ' next month (vs ' || recent || ' this month)', 'Show monthly trend of ' || crime_group || ' in ' || district FROM ({_forecast_sql(_A)})"""


_add("insights", lambda t: insights.insights(t, AS_OF), "CaseMaster Unit District CrimeHead Accused", _bundle_sql())
_add("insight_briefing", lambda t: insights.briefing(insights.insights(t, AS_OF)), "CaseMaster Unit District CrimeHead Accused", f"SELECT seq, type, title, detail, query FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY seq) AS place FROM ({_bundle_sql()})) WHERE place = 1 ORDER BY seq LIMIT 3")

# network
_STRONG = """strong AS (SELECT a1.PersonID AS p1, a2.PersonID AS p2, count(DISTINCT a1.CaseMasterID) AS w FROM Accused a1 JOIN Accused a2 ON a2.CaseMasterID = a1.CaseMasterID AND a1.PersonID < a2.PersonID GROUP BY 1, 2 HAVING count(DISTINCT a1.CaseMasterID) >= 2),
deg AS (SELECT pid, count(*) AS d FROM (SELECT p1 AS pid FROM strong UNION ALL SELECT p2 FROM strong) GROUP BY 1),
clustered AS (SELECT pid FROM deg WHERE d >= 2 ORDER BY d DESC, pid LIMIT 90),
edges AS (SELECT p1 AS source, p2 AS target, w AS weight FROM strong WHERE p1 IN (SELECT pid FROM clustered) AND p2 IN (SELECT pid FROM clustered))"""


def _network_sql(tables: str, select: str) -> str:
    return star_sql(*tables.split()).rstrip() + ",\n" + _STRONG + "\n" + select


QUERIES["network_edges"] = lambda spark, folder: network.edges(from_star(spark, folder))
SQL["network_edges"] = _network_sql("Accused", "SELECT * FROM edges")
QUERIES["network_strong_pairs"] = lambda spark, folder: network.strong_pairs(from_star(spark, folder))
SQL["network_strong_pairs"] = _network_sql("Accused", "SELECT p1 AS source, p2 AS target, w AS weight FROM strong")


def _network_nodes(spark: SparkSession, folder: str) -> DataFrame:
    t = from_star(spark, folder)
    return network.nodes(t, network.edges(t))


QUERIES["network_nodes"] = _network_nodes
SQL["network_nodes"] = _network_sql(
    "Accused CaseMaster CrimeHead",
    """, ends AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1),
modes AS (SELECT PersonID, CrimeGroupName, row_number() OVER (PARTITION BY PersonID ORDER BY count(*) DESC, CrimeGroupName) AS place FROM Accused a JOIN CaseMaster cm ON cm.CaseMasterID = a.CaseMasterID JOIN CrimeHead ch ON ch.CrimeHeadID = cm.CrimeMajorHeadID GROUP BY 1, 2)
SELECT e.id, coalesce(max(a.AccusedName), e.id) AS name, count(DISTINCT a.CaseMasterID) AS case_count, coalesce(max(m.CrimeGroupName), 'Unknown') AS crime_group, max(e.degree) AS degree
FROM ends e JOIN Accused a ON a.PersonID = e.id LEFT JOIN modes m ON m.PersonID = e.id AND m.place = 1 GROUP BY e.id""",
)


def _galaxy(spark: SparkSession, folder: str) -> DataFrame:
    t = from_star(spark, folder)
    return network.galaxy(insights.repeat_accused(t, AS_OF, days=365, top=80), [F.desc("case_count"), F.col("accused_name")])[1]


QUERIES["galaxy_edges"] = _galaxy
SQL["galaxy_edges"] = star_sql("Accused", "CaseMaster", "CrimeHead") + f"SELECT accused_name AS source, 'crime_' || unnest(string_split(crime_types, ', ')) AS target FROM ({_REPEAT.replace('LIMIT 2', 'LIMIT 80')})"

# profiles
_BAND = "CASE WHEN AgeYear < 26 THEN '18–25' WHEN AgeYear < 36 THEN '26–35' WHEN AgeYear < 46 THEN '36–45' ELSE '46+' END"
_GENDER = "CASE GenderID WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Other' END"
_add("profile_accused_age", profile.accused_age, "Accused", f"SELECT {_BAND} AS age_band, count(*) AS accused FROM Accused WHERE AgeYear IS NOT NULL GROUP BY 1")
_add("profile_accused_gender", profile.accused_gender, "Accused", f"SELECT {_GENDER} AS gender, count(*) AS accused FROM Accused WHERE GenderID IS NOT NULL GROUP BY 1")
_add("profile_victim_gender", profile.victim_gender, "Victim", f"SELECT {_GENDER} AS gender, count(*) AS victims FROM Victim WHERE GenderID IS NOT NULL GROUP BY 1")
_add("profile_occupation", profile.occupations, "ComplainantDetails OccupationMaster", "SELECT OccupationName AS occupation, count(*) AS complainants FROM ComplainantDetails JOIN OccupationMaster USING (OccupationID) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
_add("profile_religion", profile.religions, "ComplainantDetails ReligionMaster", "SELECT ReligionName AS religion, count(*) AS complainants FROM ComplainantDetails JOIN ReligionMaster USING (ReligionID) GROUP BY 1")
_add("profile_caste", profile.castes, "ComplainantDetails CasteMaster", "SELECT caste_master_name AS caste, count(*) AS complainants FROM ComplainantDetails JOIN CasteMaster ON caste_master_id = CasteID GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
_add("profile_offender", profile.offenders, "Accused CaseMaster CrimeHead", f"SELECT ch.CrimeGroupName AS crime_group, round(avg(a.AgeYear)) AS avg_age, round(100.0 * count(*) FILTER (WHERE a.GenderID = 1) / count(*))::DOUBLE AS male_pct, round(100.0 * count(*) FILTER (WHERE pc.n >= 2) / count(*))::DOUBLE AS repeat_pct FROM Accused a JOIN CaseMaster cm ON cm.CaseMasterID = a.CaseMasterID {_HEAD} LEFT JOIN (SELECT PersonID, count(DISTINCT CaseMasterID) AS n FROM Accused WHERE PersonID IS NOT NULL GROUP BY 1) pc ON pc.PersonID = a.PersonID WHERE a.AgeYear IS NOT NULL GROUP BY 1")

# cases
_SEARCH = f"""SELECT cm.CaseMasterID AS case_id, cm.CrimeNo AS crime_no, cm.CaseNo AS case_no, strftime({_D}, '%Y-%m-%d') AS date_registered, ch.CrimeGroupName AS crime_group, d.DistrictName AS district, coalesce(cs.CaseStatusName, 'Unknown') AS status
FROM CaseMaster cm {_HEAD} {_GEO} LEFT {_STATUS} {{where}} ORDER BY {_D} DESC NULLS LAST, cm.CaseMasterID LIMIT {{n}}"""
_add("case_search", lambda t: cases.search(t, "nation_1"), f"{_CASES} CaseStatusMaster", _SEARCH.format(where="WHERE d.DistrictName ILIKE '%nation\\_1%' ESCAPE '\\' OR ch.CrimeGroupName ILIKE '%nation\\_1%' ESCAPE '\\' OR cm.CrimeNo ILIKE '%nation\\_1%' ESCAPE '\\'", n=100))
_add("case_report", lambda t: cases.search(t, "", 150), f"{_CASES} CaseStatusMaster", _SEARCH.format(where="", n=150))


def _flat(df: DataFrame) -> DataFrame:
    """Case files with their arrays as text, for comparison across engines."""
    joined = lambda name, *fields: F.array_join(F.transform(name, lambda x: F.concat_ws("|", *[F.coalesce(x[f].cast("string"), F.lit("")) for f in fields])), ";").alias(name)
    return df.select("CaseMasterID", "crime_no", "station", "district", "crime_group", "crime_name", "status", "case_category", "gravity", "officer_name", "court", joined("victims", "VictimName", "AgeYear", "gender"), joined("accused", "AccusedName", "AgeYear", "gender"), joined("arrests", "ArrestSurrenderDate", "AccusedName", "arrest_district"), joined("chargesheet", "cstype", "filed_by"), joined("act_sections", "ActCode", "SectionCode", "SectionDescription"))


_FILE_TABLES = "CaseMaster Unit District CrimeHead CrimeSubHead CaseStatusMaster CaseCategory GravityOffence Employee Court Victim Accused ArrestSurrender ChargesheetDetails ActSectionAssociation Section"
_SEX = "CASE x.GenderID WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Transgender' END"


def _file_sql() -> str:
    s = lambda e: f"coalesce({e}::VARCHAR, '')"
    return f"""SELECT cm.CaseMasterID, cm.CrimeNo AS crime_no, u.UnitName AS station, d.DistrictName AS district, ch.CrimeGroupName AS crime_group, csh.CrimeHeadName AS crime_name, cs.CaseStatusName AS status, cc.LookupValue AS case_category, g.LookupValue AS gravity, e.FirstName AS officer_name, ct.CourtName AS court,
  coalesce(v.t, '') AS victims, coalesce(a.t, '') AS accused, coalesce(r.t, '') AS arrests, coalesce(c.t, '') AS chargesheet, coalesce(n.t, '') AS act_sections
FROM CaseMaster cm LEFT JOIN Unit u ON u.UnitID = cm.PoliceStationID LEFT JOIN District d ON d.DistrictID = u.DistrictID LEFT JOIN CrimeHead ch ON ch.CrimeHeadID = cm.CrimeMajorHeadID LEFT JOIN CrimeSubHead csh ON csh.CrimeSubHeadID = cm.CrimeMinorHeadID
LEFT JOIN CaseStatusMaster cs ON cs.CaseStatusID = cm.CaseStatusID LEFT JOIN CaseCategory cc ON cc.CaseCategoryID = cm.CaseCategoryID LEFT JOIN GravityOffence g ON g.GravityOffenceID = cm.GravityOffenceID LEFT JOIN Employee e ON e.EmployeeID = cm.PolicePersonID LEFT JOIN Court ct ON ct.CourtID = cm.CourtID
LEFT JOIN (SELECT CaseMasterID, string_agg({s("x.VictimName")} || '|' || {s("x.AgeYear")} || '|' || {_SEX}, ';' ORDER BY x.VictimName, x.AgeYear, {_SEX}) AS t FROM Victim x GROUP BY 1) v ON v.CaseMasterID = cm.CaseMasterID
LEFT JOIN (SELECT CaseMasterID, string_agg({s("x.AccusedName")} || '|' || {s("x.AgeYear")} || '|' || {_SEX}, ';' ORDER BY x.AccusedName, x.AgeYear, {_SEX}) AS t FROM Accused x GROUP BY 1) a ON a.CaseMasterID = cm.CaseMasterID
LEFT JOIN (SELECT x.CaseMasterID, string_agg({s("x.ArrestSurrenderDate")} || '|' || {s("y.AccusedName")} || '|' || {s("z.DistrictName")}, ';' ORDER BY x.ArrestSurrenderDate, y.AccusedName, z.DistrictName) AS t FROM ArrestSurrender x LEFT JOIN Accused y ON y.AccusedMasterID = x.AccusedMasterID AND y.CaseMasterID = x.CaseMasterID LEFT JOIN District z ON z.DistrictID = x.ArrestSurrenderDistrictId GROUP BY 1) r ON r.CaseMasterID = cm.CaseMasterID
LEFT JOIN (SELECT x.CaseMasterID, string_agg({s("x.cstype")} || '|' || {s("y.FirstName")}, ';' ORDER BY x.csdate, x.cstype) AS t FROM ChargesheetDetails x LEFT JOIN Employee y ON y.EmployeeID = x.PolicePersonID GROUP BY 1) c ON c.CaseMasterID = cm.CaseMasterID
LEFT JOIN (SELECT x.CaseMasterID, string_agg(x.ActCode || '|' || x.SectionCode || '|' || {s("y.SectionDescription")}, ';' ORDER BY x.ActCode, x.SectionCode) AS t FROM ActSectionAssociation x LEFT JOIN Section y ON y.ActCode = x.ActCode AND y.SectionCode = x.SectionCode GROUP BY 1) n ON n.CaseMasterID = cm.CaseMasterID"""


_add("case_files", lambda t: _flat(cases.case_files(t)), _FILE_TABLES, _file_sql())
_add("case_file", lambda t: _flat(cases.case_file(t, 42)), _FILE_TABLES, _file_sql() + " WHERE cm.CaseMasterID = 42")
_PLACES = [(k, f"nation_{k}", 10.0 + k, 70.0 + k) for k in range(12)]


def _map(spark: SparkSession, folder: str) -> DataFrame:
    return cases.map_data(cases.district_counts(from_star(spark, folder)), spark.createDataFrame(_PLACES, "seq int, name string, latitude double, longitude double")).withColumn("share", F.round("share", 6))


QUERIES["map_data"] = _map
SQL["map_data"] = (
    star_sql("CaseMaster", "Unit", "District").rstrip()
    + f", places(seq, place, latitude, longitude) AS (VALUES {', '.join(f'''({a}, '{b}', {c}::DOUBLE, {d}::DOUBLE)''' for a, b, c, d in _PLACES)}), counts AS (SELECT d.DistrictName AS name, count(*) AS count FROM CaseMaster cm {_GEO} GROUP BY 1), ranked AS (SELECT *, row_number() OVER (ORDER BY count DESC, name)::INT AS rank, round(count / greatest(max(count) OVER (), 1), 6) AS share FROM counts) "
    "SELECT rank, name, count, share, latitude, longitude FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY (name = place) DESC, seq) AS n FROM ranked JOIN places ON contains(lower(name), lower(place)) OR contains(lower(place), lower(name))) WHERE n = 1"
)

# risk
_add(
    "risk_scores",
    lambda t: risk.with_risk(risk.case_features(t, AS_OF)).select("CaseMasterID", "has_arrest", F.col("days").cast("bigint").alias("days"), "heinous", "victim_count", "accused_count", F.round("probability", 9).alias("probability"), "label", F.array_join(F.transform("contributions", lambda x: F.concat(x["sign"], x["label"])), "; ").alias("reasons")),
    "CaseMaster ArrestSurrender Victim Accused GravityOffence",
    f"""SELECT CaseMasterID, has_arrest, days, heinous, victim_count, accused_count, round(p, 9) AS probability, CASE WHEN p >= 0.5 THEN 'Likely charge-sheeted' WHEN p >= 0.25 THEN 'Moderate likelihood' ELSE 'Unlikely to be charge-sheeted' END AS label,
  concat_ws('; ', CASE WHEN has_arrest THEN '+Arrest made (precondition for chargesheet)' ELSE '-No arrest yet — chargesheet is rare without one' END, CASE WHEN has_arrest THEN CASE WHEN tf >= 0.5 THEN '+' ELSE '-' END || 'Investigation time elapsed (' || floor(tf * 100 + 0.5)::BIGINT || '% of the ~180-day window)' END, CASE WHEN heinous THEN '+Heinous offence — higher investigative priority' END, CASE WHEN accused_count > 1 THEN '+Multiple accused (' || accused_count || ') named' END) AS reasons
FROM (SELECT *, CASE WHEN has_arrest THEN (20 + 60 * tf) / (68 + 60 * tf) ELSE 0.02::DOUBLE END AS p FROM (
  SELECT cm.CaseMasterID, coalesce(r.n, 0) > 0 AS has_arrest, date_diff('day', {_D}, DATE '{AS_OF[:10]}') AS days, g.LookupValue = 'Heinous' AS heinous, coalesce(v.n, 0) AS victim_count, coalesce(a.n, 0) AS accused_count, least(greatest(date_diff('day', {_D}, DATE '{AS_OF[:10]}'), 0) / 180::DOUBLE, 1.0) AS tf
  FROM CaseMaster cm LEFT JOIN GravityOffence g ON g.GravityOffenceID = cm.GravityOffenceID LEFT JOIN (SELECT CaseMasterID, count(*) AS n FROM ArrestSurrender GROUP BY 1) r ON r.CaseMasterID = cm.CaseMasterID LEFT JOIN (SELECT CaseMasterID, count(*) AS n FROM Victim GROUP BY 1) v ON v.CaseMasterID = cm.CaseMasterID LEFT JOIN (SELECT CaseMasterID, count(*) AS n FROM Accused GROUP BY 1) a ON a.CaseMasterID = cm.CaseMasterID))""",
)


# retrieval
def _word_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return retrieval.by_words(docs, WORDS, 20, "text", "doc_id").select("doc_id", F.round("score", 9).alias("score"))


QUERIES["retrieval_words"] = _word_search
_ASKED = "[" + ", ".join(f"'{w}'" for w in WORDS.split() if len(w) > 2) + "]"
SQL["retrieval_words"] = f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2) AS ws FROM documents),
s AS (SELECT doc_id, list_filter(ws, lambda x: list_contains({_ASKED}, x)) AS f FROM w), best AS (SELECT doc_id, f, len(f) / (len(f) + 1) AS score FROM s WHERE len(f) > 0 ORDER BY score DESC, doc_id LIMIT 80)
SELECT doc_id, round(score, 9) AS score FROM best WHERE len(list_filter({_ASKED}, lambda x: list_contains(f, x))) >= 2 ORDER BY best.score DESC, doc_id LIMIT 20"""


def _vector_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    asked = rows.filter("vec_id = 0").first()["embedding"]
    return retrieval.by_vector(rows, asked, 10, "embedding", "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


QUERIES["retrieval_vector"] = _vector_search
SQL["retrieval_vector"] = "SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.embedding IS NOT NULL ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 10"


def _examples(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("text").alias("question"))
    return retrieval.similar_examples(rows, "and the thing that was there", 10).select("idx", F.round("score", 9).alias("score"))


QUERIES["retrieval_examples"] = _examples
SQL["retrieval_examples"] = """WITH r AS (SELECT conv_id * 1000 + turn AS idx, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: length(x) >= 3)) AS a FROM conversations WHERE role = 'user'), s AS (SELECT idx, a, ['and', 'the', 'thing', 'that', 'was', 'there'] AS b FROM r),
j AS (SELECT idx, CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END AS score FROM s) SELECT idx, round(score, 9) AS score FROM j ORDER BY j.score DESC, idx LIMIT 10"""

# reading by conditions, and upkeep
_add(
    "find_many",
    lambda t: filters.find_many(t["CaseMaster"], {"AND": [{"CaseStatusID": {"in": [1, 2]}}, {"OR": [{"CrimeNo": {"endsWith": "7"}}, {"BriefFacts": {"contains": "STATION 12", "mode": "insensitive"}}]}], "NOT": {"CrimeMajorHeadID": 1}}, [{"CrimeRegisteredDate": {"sort": "desc", "nulls": "last"}}, {"CaseMasterID": "asc"}], take=50, skip=10, select=["CaseMasterID", "CrimeNo", "CrimeRegisteredDate"]),
    "CaseMaster",
    "SELECT CaseMasterID, CrimeNo, CrimeRegisteredDate FROM CaseMaster WHERE CaseStatusID IN (1, 2) AND (CrimeNo LIKE '%7' OR lower(BriefFacts) LIKE '%station 12%') AND NOT CrimeMajorHeadID = 1 ORDER BY CrimeRegisteredDate DESC NULLS LAST, CaseMasterID LIMIT 50 OFFSET 10",
)
_add(
    "group_by_having",
    lambda t: filters.group_by(t["Accused"], ["GenderID"], {"AgeYear": {"gte": 20}}, {"_count": {"gt": 10}}, _count=True, _avg=["AgeYear"], _min=["AgeYear"], _max=["AgeYear"]).withColumn("_avg_AgeYear", F.round("_avg_AgeYear", 6)),
    "Accused",
    "SELECT GenderID, count(*) AS _count, round(avg(AgeYear), 6) AS _avg_AgeYear, min(AgeYear) AS _min_AgeYear, max(AgeYear) AS _max_AgeYear FROM Accused WHERE AgeYear >= 20 GROUP BY 1 HAVING count(*) > 10",
)
_add("relation_some", lambda t: filters.related(t["CaseMaster"], t["Accused"], "CaseMasterID", "CaseMasterID", some={"AgeYear": {"lt": 12}}, none={"GenderID": 3}).select("CaseMasterID"), "CaseMaster Accused", "SELECT CaseMasterID FROM CaseMaster cm WHERE EXISTS (SELECT 1 FROM Accused a WHERE a.CaseMasterID = cm.CaseMasterID AND a.AgeYear < 12) AND NOT EXISTS (SELECT 1 FROM Accused a WHERE a.CaseMasterID = cm.CaseMasterID AND a.GenderID = 3)")
_add("relation_every", lambda t: filters.related(t["CaseMaster"], t["Accused"], "CaseMasterID", "CaseMasterID", every={"GenderID": {"in": [1, 2]}}).select("CaseMasterID"), "CaseMaster Accused", "SELECT CaseMasterID FROM CaseMaster cm WHERE NOT EXISTS (SELECT 1 FROM Accused a WHERE a.CaseMasterID = cm.CaseMasterID AND NOT coalesce(a.GenderID IN (1, 2), false))")
_add("cases_without_arrest", lambda t: upkeep.missing(t["ArrestSurrender"], t["CaseMaster"].select("CaseMasterID"), ["CaseMasterID"]), "CaseMaster ArrestSurrender", "SELECT CaseMasterID FROM CaseMaster WHERE CaseMasterID NOT IN (SELECT CaseMasterID FROM ArrestSurrender)")
_add(
    "update_from",
    lambda t: upkeep.update_from(t["CaseMaster"].select("CaseMasterID", "CaseStatusID"), t["ChargesheetDetails"].select("CaseMasterID", F.lit(9).alias("CaseStatusID")), ["CaseMasterID"]),
    "CaseMaster ChargesheetDetails",
    "SELECT cm.CaseMasterID, CASE WHEN s.CaseMasterID IS NOT NULL THEN 9 ELSE cm.CaseStatusID END AS CaseStatusID FROM CaseMaster cm LEFT JOIN ChargesheetDetails s ON s.CaseMasterID = cm.CaseMasterID",
)
_add("first_accused", lambda t: upkeep.first_child(t["CaseMaster"].select("CaseMasterID"), t["Accused"], "CaseMasterID", "CaseMasterID", "AccusedMasterID", ["AccusedName"]), "CaseMaster Accused", "SELECT cm.CaseMasterID, a.AccusedName FROM CaseMaster cm LEFT JOIN (SELECT CaseMasterID, first(AccusedName ORDER BY AccusedMasterID, AccusedName) AS AccusedName FROM Accused GROUP BY 1) a ON a.CaseMasterID = cm.CaseMasterID")


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    nested = upkeep.with_children(rows.select("conv_id").distinct(), rows, "conv_id", ["turn"], ["role", "text"], "messages")
    return nested.select("conv_id", F.size("messages").cast("bigint").alias("n"), F.sha2(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n"), 256).alias("digest"))


QUERIES["conversations_nested"] = _conversations
SQL["conversations_nested"] = "SELECT conv_id, count(*) AS n, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY 1"


def _json_props(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/events.parquet")
    return filters.find_many(rows, {"event_type": {"in": ["click", "error"]}}, select=["event_id", "event_type", "props"]).select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


QUERIES["event_properties"] = _json_props
SQL["event_properties"] = "SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE event_type IN ('click', 'error')"


def entry(spark: SparkSession, folder: str) -> DataFrame:
    return cases.district_counts(from_star(spark, folder))
