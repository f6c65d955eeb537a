"""Edge semantics on rows made by hand."""

import time
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.functions import timewin as W
from casewright.operators import cases, filters, forecast, insights, network, profile, retrieval, risk, upkeep
from casewright.plans import corpus
from casewright.sources.tables import SCHEMAS, Tables

AS_OF = "2024-05-15 12:00:00"


def tables(spark, **rows):
    """Tables with the given rows, as dicts; the others empty."""
    made = {}
    for name, ddl in SCHEMAS.items():
        schema = spark.createDataFrame([], ddl).schema
        made[name] = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows.get(name, [])], schema)
    return Tables(made)


def lookups():
    return {
        "District": [{"DistrictID": 1, "DistrictName": "North"}, {"DistrictID": 2, "DistrictName": "South"}],
        "Unit": [{"UnitID": 1, "UnitName": "N1", "DistrictID": 1}, {"UnitID": 2, "UnitName": "S1", "DistrictID": 2}],
        "CrimeHead": [{"CrimeHeadID": 1, "CrimeGroupName": "Theft"}, {"CrimeHeadID": 2, "CrimeGroupName": "Fraud"}],
        "CaseStatusMaster": [{"CaseStatusID": 1, "CaseStatusName": "Closed"}],
        "GravityOffence": [{"GravityOffenceID": 1, "LookupValue": "Heinous"}],
    }


def case(i, day, unit=1, head=1, **more):
    return {"CaseMasterID": i, "CrimeRegisteredDate": day, "PoliceStationID": unit, "CrimeMajorHeadID": head, **more}


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_bounds():
    assert W.months_before(datetime(2024, 3, 31), 1) == datetime(2024, 2, 29)
    assert W.month_start(datetime(2024, 1, 20), 2) == datetime(2023, 11, 1)
    # a date is its midnight, so the day of a bound at noon is out
    assert W.first_day(datetime(2024, 5, 1, 12)) == date(2024, 5, 2)
    assert W.first_day(datetime(2024, 5, 1)) == date(2024, 5, 1)


@pytest.mark.parametrize(("before", "now", "found"), [(5, 50, False), (6, 7, True), (20, 23, False), (20, 24, True)])
def test_spike_boundaries(spark, before, now, found):
    made = [case(i, date(2024, 3, 31)) for i in range(before)] + [case(100 + i, date(2024, 4, 1)) for i in range(now)] + [case(900, date(2024, 5, 1)), case(901, date(2024, 2, 29))]
    got = rows(insights.spikes(tables(spark, CaseMaster=made, **lookups()), AS_OF))
    assert got == ([("North", now, before, int((now - before) / before * 100 + 0.5))] if found else [])


def test_surge_takes_the_largest_before_it_tests(spark):
    week, last = date(2024, 5, 12), date(2024, 5, 5)
    made = [case(i, week) for i in range(10)] + [case(50 + i, last) for i in range(10)] + [case(100 + i, week, head=2) for i in range(7)]
    assert rows(insights.weekly_surge(tables(spark, CaseMaster=made, **lookups()), AS_OF)) == []
    made = [case(i, week, head=2) for i in range(7)]
    assert rows(insights.weekly_surge(tables(spark, CaseMaster=made, **lookups()), AS_OF)) == [("Fraud", 7, 0, 0)]


def test_repeat_accused_go_by_name(spark):
    made = [case(i, date(2024, 5, 10), head=1 + i % 2) for i in range(4)]
    people = [{"AccusedMasterID": 10 * i + k, "CaseMasterID": i, "AccusedName": "A"} for i in range(3) for k in range(2)] + [{"AccusedMasterID": 99, "CaseMasterID": 3, "AccusedName": None}]
    assert rows(insights.repeat_accused(tables(spark, CaseMaster=made, Accused=people, **lookups()), AS_OF)) == [("A", 3, "Fraud, Theft")]


def test_trend_fills_missing_months_and_passes_over_later_ones(spark):
    counts = {date(2023, 12, 5): 1, date(2024, 1, 5): 2, date(2024, 3, 5): 4, date(2024, 4, 5): 5, date(2024, 5, 5): 6, date(2024, 6, 1): 50}
    made, i = [], 0
    for day, n in counts.items():
        for _ in range(n):
            made.append(case(i := i + 1, day))
    t = tables(spark, CaseMaster=made, **lookups())
    assert rows(forecast.series(t, AS_OF).select("y")) == [([1, 2, 0, 4, 5, 6],)]
    ((district, group, slope, projected, recent, score),) = rows(forecast.forecasts(t, AS_OF))
    expected = (6 * (2 + 12 + 20 + 30) - 15 * 18) / 105
    assert (district, group, recent) == ("North", "Theft", 6) and abs(slope - expected) < 1e-12
    assert projected == int(18 / 6 - expected * 2.5 + 6 * expected + 0.5) and abs(score - (slope + projected - recent)) < 1e-12


@pytest.mark.parametrize(("y", "rises"), [([0, 0, 2, 2, 3, 4], False), ([1, 1, 2, 2, 3, 3], False), ([0, 1, 2, 3, 3, 3], True)])
def test_trend_thresholds(spark, y, rises):
    made, i = [], 0
    for month, n in zip([date(2023, 12, 1), date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1), date(2024, 4, 1), date(2024, 5, 1)], y, strict=True):
        for _ in range(n):
            made.append(case(i := i + 1, month))
    assert bool(rows(forecast.forecasts(tables(spark, CaseMaster=made, **lookups()), AS_OF))) == rises


def test_network(spark):
    together = {1: "ABC", 2: "ABC", 3: "DE", 4: "DE", 5: "AD"}
    people = [{"AccusedMasterID": 10 * c + k, "CaseMasterID": c, "PersonID": p, "AccusedName": None if p == "A" else p.lower()} for c, members in together.items() for k, p in enumerate(members)]
    people += [{"AccusedMasterID": 500, "CaseMasterID": 1, "PersonID": "A"}, {"AccusedMasterID": 501, "CaseMasterID": 1, "PersonID": None}]
    t = tables(spark, Accused=people, CaseMaster=[case(c, date(2024, 1, 1), head=1 + c % 2) for c in together], **lookups())
    edges = network.edges(t)
    assert rows(edges) == [("A", "B", 2), ("A", "C", 2), ("B", "C", 2)]  # D and E are a pair alone, A and D share one case
    nodes = {r.id: r for r in network.nodes(t, edges).collect()}
    assert nodes["A"].name == "A" and nodes["A"].case_count == 3 and nodes["A"].degree == 2
    assert nodes["B"].name == "b" and nodes["B"].crime_group == "Fraud"  # a tie: the first by name
    empty = network.edges(tables(spark, **lookups()))
    assert rows(empty) == [] and rows(network.nodes(tables(spark, **lookups()), empty)) == []


def test_galaxy(spark):
    df = spark.createDataFrame([(1, "Ann B C", 3, "Theft, Fraud"), (2, "Ann B C", 9, "Arson"), (3, None, None, "")], "n int, accused_name string, case_count int, crime_types string")
    nodes, edges = network.galaxy(df, [F.col("n")])
    assert sorted(rows(edges)) == [("Ann B C", "crime_Fraud"), ("Ann B C", "crime_Theft")]
    found = {r.id: r for r in nodes.collect()}
    assert found["Ann B C"].label == "Ann B" and found["Ann B C"]["count"] == 3 and found["Unknown"]["count"] == 1 and "crime_Arson" in found


def test_profiles(spark):
    people = [{"AccusedMasterID": i, "CaseMasterID": i % 3, "AgeYear": age, "GenderID": g, "PersonID": p} for i, (age, g, p) in enumerate([(10, 1, "x"), (26, 1, "x"), (36, 3, None), (None, 2, "y"), (46, None, "y")])]
    t = tables(spark, Accused=people, CaseMaster=[case(i, date(2024, 1, 1)) for i in range(3)], **lookups())
    assert rows(profile.accused_age(t)) == [("18–25", 1), ("26–35", 1), ("36–45", 1), ("46+", 1)]
    assert rows(profile.accused_gender(t)) == [("Male", 2), ("Female", 1), ("Other", 1)]
    # unknown gender and person are in the base; half away from zero
    assert rows(profile.offenders(t)) == [("Theft", 30.0, 50.0, 75.0)]


def test_case_file(spark):
    t = tables(
        spark,
        CaseMaster=[case(7, date(2024, 1, 2), CaseStatusID=1), case(8, None, unit=None)],
        Victim=[{"VictimMasterID": 1, "CaseMasterID": 7, "VictimName": "V", "GenderID": None}],
        Accused=[{"AccusedMasterID": k, "CaseMasterID": 7, "AccusedName": f"A{k}", "GenderID": k} for k in (2, 1)],
        ArrestSurrender=[{"ArrestSurrenderID": 1, "CaseMasterID": 7, "AccusedMasterID": 2, "ArrestSurrenderDistrictId": 2, "ArrestSurrenderDate": date(2024, 1, 3)}],
        **lookups(),
    )
    (r,) = cases.case_file(t, 7).collect()
    assert r.station == "N1" and r.status == "Closed" and [tuple(x) for x in r.victims] == [("V", None, "Transgender")]
    assert [x.AccusedName for x in r.accused] == ["A1", "A2"] and [tuple(x) for x in r.arrests] == [(date(2024, 1, 3), "A2", "South")] and r.chargesheet == []
    assert rows(cases.case_file(t, 99)) == []
    (r,) = cases.case_file(t, 8).collect()
    assert r.station is None and r.accused == []
    with pytest.raises(ValueError):
        cases.case_file(t, "7")


def test_search_takes_signs_as_they_are(spark):
    t = tables(spark, CaseMaster=[case(1, date(2024, 1, 1), CrimeNo="10%"), case(2, None, CrimeNo="100"), case(3, date(2024, 2, 1), CrimeNo="x")], **lookups())
    assert [r.case_id for r in cases.search(t, "0%").collect()] == [1]
    assert [r.case_id for r in cases.search(t, "NORTH").collect()] == [3, 1, 2]
    with pytest.raises(ValueError):
        cases.search(t, limit=0)


def test_map_data(spark):
    counts = spark.createDataFrame([("Upper North", 4), ("South", 2), ("Nowhere", 1)], "name string, count bigint")
    places = spark.createDataFrame([(1, "north", 1.0, 2.0), (2, "SOUTH", 3.0, 4.0), (3, "South", 5.0, 6.0)], "seq int, name string, latitude double, longitude double")
    assert sorted(rows(cases.map_data(counts, places))) == [(1, "Upper North", 4, 1.0, 1.0, 2.0), (2, "South", 2, 0.5, 5.0, 6.0)]


def test_risk(spark):
    df = spark.createDataFrame([(1, True, 200.0, True, 2), (2, False, 200.0, True, 1), (3, True, 10.0, False, 1), (4, None, None, None, None), (5, True, -3.0, False, 1)], "id int, has_arrest boolean, days double, heinous boolean, accused_count int")
    got = {r.id: r for r in risk.with_risk(df).collect()}
    assert got[1].probability == 0.625 and got[1].label == "Likely charge-sheeted" and len(got[1].contributions) == 4
    assert got[2].probability == 0.02 and len(got[2].contributions) == 2
    assert abs(got[3].probability - 0.32710) < 1e-4 and got[3].label == "Moderate likelihood"
    assert got[4].probability == 0.02 and abs(got[5].probability - 20 / 68) < 1e-12


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "theft of a bicycle near the market"), (2, "stolen bicycle"), (3, None), (4, "bicycle bicycle bicycle"), (5, "theft and bicycle thieves")], "id int, text string")
    assert [r.id for r in retrieval.by_words(docs, "bicycle theft").collect()] == [1, 5]
    assert [r.id for r in retrieval.by_words(docs, "bicycle", 2).collect()] == [4, 1]
    # a repeated word counts each time
    assert [r.id for r in retrieval.by_words(docs, "bicycle bicycle", 2).collect()] == [4, 1]
    assert rows(retrieval.by_words(docs, "a !")) == []
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "id int, embedding array<float>")
    assert [r.id for r in retrieval.by_vector(vectors, [1.0, 0.1]).collect()] == [1, 4]
    both = docs.join(vectors, "id", "left")
    assert [r.id for r in retrieval.similar(both, "bicycle theft", 1, embed=lambda q: None).collect()] == [1]
    assert [r.id for r in retrieval.similar(both, "x", 1, embed=lambda q: [1.0, 1.0]).collect()] == [4]
    examples = spark.createDataFrame([(0, "cases in a district"), (1, "cases by month"), (2, "")], "idx int, question string")
    assert [(r.idx, r.score) for r in retrieval.similar_examples(examples, "cases district", 2).collect()] == [(0, 1.0), (1, 1 / 3)]
    assert [r.idx for r in retrieval.similar_examples(examples, "cases district", 2, exclude=0).collect()] == [1, 2]


def test_examples_with_nothing_found(spark):
    t = tables(spark, **lookups())
    assert rows(corpus.qx04_district_arrests(t, AS_OF, "North")) == []
    assert rows(corpus.qx11_subhead_count(t, AS_OF, "x")) == [(0,)]


def test_columns(spark):
    df = spark.createDataFrame([(-2.5, "abcdefghijklmno", "a, ,b"), (2.5, "short", "")], "x double, s string, l string")
    assert rows(df.select(C.half_up(F.col("x")), F.round("x"), C.shortened(F.col("s")), C.split_list(F.col("l")))) == [(-2, -3.0, "abcdefghijklm…", ["a", "b"]), (3, 3.0, "short", [])]


def test_filters(spark):
    df = spark.createDataFrame([(1, "Ann", 20, '{"a": {"b": "x"}}'), (2, "bob", None, '{"a": {"b": "y"}}'), (3, None, 30, None)], "id int, name string, age int, doc string")
    ids = lambda where: [r.id for r in filters.find_many(df, where, [{"id": "asc"}]).collect()]
    assert ids({"name": {"equals": "ANN", "mode": "insensitive"}}) == [1]
    assert ids({"age": None}) == [2] and ids({"age": {"not": None}}) == [1, 3]
    assert ids({"OR": [{"age": {"gte": 30}}, {"name": {"startsWith": "b"}}]}) == [2, 3]
    assert ids({"NOT": {"id": {"in": [1, 3]}}}) == [2] and ids({"id": {"notIn": [1]}}) == [2, 3]
    assert ids({"doc": {"path": ["a", "b"], "equals": "y"}}) == [2]
    assert [r.id for r in filters.find_many(df, None, [{"age": {"sort": "desc", "nulls": "last"}}], skip=1, take=1).collect()] == [1]
    assert [r.id for r in filters.find_many(df, None, [{"id": "desc"}], cursor={"id": 2}).collect()] == [2, 1]
    assert rows(filters.aggregate(df, _count=True, _avg=["age"], _max=["age"])) == [(3, 25.0, 30)]
    children = spark.createDataFrame([(1, 5), (1, 6), (3, 5)], "parent int, v int")
    related = lambda **how: sorted(r.id for r in filters.related(df, children, "id", "parent", **how).collect())
    assert related(some={"v": 6}) == [1] and related(every={"v": 5}) == [2, 3] and related(none={"v": 6}) == [2, 3]
    assert [r.kids for r in filters.with_count(df, children, "id", "parent", "kids").orderBy("id").collect()] == [2, 0, 1]
    with pytest.raises(LookupError):
        filters.find_unique(df, {"id": 9}, or_throw=True)


def test_upkeep(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "id int, v string")
    assert sorted(rows(upkeep.insert_new(target, new, ["id"]))) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(rows(upkeep.update_from(target, spark.createDataFrame([(2, None)], "id int, v string"), ["id"]))) == [(1, "a"), (2, None)]
    assert sorted(rows(upkeep.upsert(target, new.dropDuplicates(), ["id"]))) == [(1, "a"), (2, "x"), (3, "c")]
    child = spark.createDataFrame([(10, 1), (11, 2)], "cid int, id int")
    kept, kids = upkeep.delete_with_dependents(target, child, target.filter("id = 1"), "id", "id")
    assert rows(kept) == [(2, "b")] and rows(kids) == [(11, 2)]
    assert rows(upkeep.with_ids(target.select("v"), "n", ["v"])) == [("a", 1), ("b", 2)]
    waiting = spark.createDataFrame([(3, "t", None), (1, "t", None), (2, None, None), (4, "t", [1.0])], "id int, text string, e array<float>")
    assert [r.id for r in upkeep.to_backfill(waiting, "id", "text", "e", 1).collect()] == [1]
    assert sorted(rows(upkeep.with_children(target, child, "id", ["cid"], [], "kids"))) == [(1, "a", [(10,)]), (2, "b", [(11,)])]


def test_refused_batches_are_asked_again(spark):
    from casewright.sources import store

    class Service:
        def __init__(self, refusals):
            self.left = refusals

        def __call__(self, values):
            self.left -= 1
            if self.left >= 0:
                raise ConnectionError("too many requests")
            return [v * 2 for v in values][:2]

    rows = spark.range(3).coalesce(1)
    told = lambda refusals: [r.n for r in store.enriched(rows, "id", "n", "bigint", Service(refusals), retries=2, wait=0.01).orderBy("id").collect()]
    # results that are missing are null, as are those of a batch that is refused for good
    assert told(0) == [0, 2, None] and told(2) == [0, 2, None] and told(3) == [None, None, None]
    began = time.monotonic()
    store.enriched(rows, "id", "n", "bigint", Service(0), batch=1, per_minute=600).collect()
    assert time.monotonic() - began > 0.2


def test_numbers_zips_and_histories(spark):
    from casewright.operators import upkeep

    rows = spark.createDataFrame([(k % 7, k) for k in range(500)], "a int, b int")
    for ranges in (1, 4, 64):
        got = sorted((r.a, r.b, r.i) for r in upkeep.with_ids(rows, "i", ["a", "b"], 5, ranges).collect())
        assert [x[2] for x in got] == list(range(5, 505))
    assert upkeep.with_ids(rows.limit(0), "i", ["a"]).count() == 0
    pairs = upkeep.zipped(rows.select("b"), rows.filter("b < 3").select(F.col("b").alias("c")), ["b"], ["c"]).orderBy("place").collect()
    assert [(r.place, r.b, r.c) for r in pairs] == [(0, 0, 0), (1, 1, 1), (2, 2, 2)]
    last = upkeep.history(rows, 2, "a", ["b"]).filter("a = 0").collect()
    assert sorted(r.b for r in last) == [490, 497]
    merged = upkeep.merged_by_id(spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string"), spark.createDataFrame([(2, "b"), (2, "a"), (3, "c")], "id int, t string"), "id")
    assert [tuple(r) for r in merged.collect()] == [(2, "a")]
    tables = {"p": rows, "c": rows, "g": rows, "o": rows}
    left = upkeep.truncated(tables, ["p"], {"c": ["p"], "g": ["c", "o"]})
    assert {k: v.count() for k, v in left.items()} == {"p": 0, "c": 0, "g": 0, "o": 500}


def test_more_entries_make_more_tasks(spark, monkeypatch):
    """Entries and pairs are dealt into parts by their number, whatever the session's partitions are."""
    monkeypatch.setattr(C, "SHARE", 10)
    people = [(10 * c + p, c, f"N{p}", 30, p) for c in range(100) for p in range(4) if (c + p) % 3]
    made = spark.createDataFrame([(c, date.fromisoformat(AS_OF[:10])) for c in range(100)], "CaseMasterID bigint, CrimeRegisteredDate date")
    accused = spark.createDataFrame([(*x[:4], str(x[4])) for x in people], "AccusedMasterID bigint, CaseMasterID bigint, AccusedName string, AgeYear int, PersonID string")
    t = Tables({"CaseMaster": made, "Accused": accused})
    pairs, repeated = network.strong_pairs(t), corpus.qx03_repeat_accused(t, AS_OF)
    parts = -(-len(people) // 10)
    for df, n in ((pairs, 2 * parts), (repeated, parts)):
        assert f", {n})" in df._jdf.queryExecution().executedPlan().toString()
    shared = Counter((str(a[4]), str(b[4])) for a in people for b in people if a[1] == b[1] and a[4] < b[4])
    assert {(r.source, r.target): r.weight for r in pairs.collect()} == {k: n for k, n in shared.items() if n > 1}
    assert {r.AccusedName: r.case_count for r in repeated.collect()} == Counter(x[2] for x in people)
