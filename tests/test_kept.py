"""Crowded cases, caches by entry, pace, insights by day, updates in place, the gate's bounds, the fitted classifier."""

import itertools
import os
import random
import time
from collections import Counter
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casewright.operators import classify, daily, insights, network, upkeep
from casewright.plans import sqlgate
from casewright.sources import entries, generator

NOW = datetime(2024, 1, 1)


@pytest.mark.parametrize("least", [2, 3])
@pytest.mark.parametrize("heavy", [500, 10, 4])
def test_pairs_of_crowded_cases(spark, least, heavy):
    r = random.Random(3)
    rows = [(c, f"p{p}") for c in range(25) for p in r.sample(range(30), r.choice([2, 3, 5, 15, 25]))]
    weights = Counter()
    for c in range(25):
        weights.update(itertools.combinations(sorted(p for k, p in rows if k == c), 2))
    want = {pair: n for pair, n in weights.items() if n >= least}
    t = {"Accused": spark.createDataFrame(rows + rows[:20] + [(1, None)], "CaseMasterID bigint, PersonID string")}
    assert {(x.source, x.target): x.weight for x in network.strong_pairs(t, least, heavy=heavy).collect()} == want
    assert {x.id: x.degree for x in network.strong_degrees(t, least, heavy).collect()} == Counter(p for pair in want for p in pair)


def test_a_case_of_fifty_thousand_persons(spark):
    person = F.concat(F.lit("p"), F.col("id")).alias("PersonID")
    crowd = spark.range(50_000).select(F.lit(1).cast("bigint").alias("CaseMasterID"), person)
    fours = spark.range(50_000).select((F.floor(F.col("id") / 4) + 10).alias("CaseMasterID"), person)
    t = {"Accused": crowd.unionByName(fours)}
    assert network.strong_pairs(t).count() == 50_000 // 4 * 6
    # two crowded cases make every pair of their persons strong: counted, not listed
    both = {"Accused": t["Accused"].unionByName(crowd.withColumn("CaseMasterID", F.lit(2).cast("bigint")))}
    assert {(r.degree, r["count"]) for r in network.strong_degrees(both).groupBy("degree").count().collect()} == {(49_999, 50_000)}


def test_cache_by_entry(spark, tmp_path):
    path = str(tmp_path / "kept")
    asked = []

    def compute(texts):
        asked.append(sorted(r.text for r in texts.collect()))
        return texts.select("hash", F.when(F.col("text") != "bad", F.length("text")).alias("value"))

    rows = spark.createDataFrame([(1, "one"), (2, "three"), (3, "one"), (4, None), (5, "bad"), (6, "")], "id int, text string").withColumn("a.b", F.lit(1)).withColumn("hash", F.lit("h"))
    values = lambda df: {r.id: r.n for r in df.collect()}
    want = {1: 3, 2: 5, 3: 3, 4: None, 5: None, 6: 0}
    assert values(entries.through(rows, "text", "n", path, NOW, 60, compute)) == want and asked[-1] == ["", "bad", "one", "three"]
    later = rows.withColumn("text", F.when(F.col("id") == 2, F.lit("four")).otherwise(F.col("text")))
    assert values(entries.through(later, "text", "n", path, NOW + timedelta(minutes=30), 60, compute)) == want | {2: 4} and asked[-1] == ["bad", "four"]
    # the first entries have aged, the fourth has not
    assert values(entries.through(later, "text", "n", path, NOW + timedelta(minutes=80), 60, compute)) == want | {2: 4} and asked[-1] == ["", "bad", "one"]
    to = entries.compacted(spark, path, str(tmp_path / "compact"), NOW + timedelta(minutes=85), 60)
    assert spark.read.parquet(to).count() == 3 and values(entries.through(later, "text", "n", to, NOW + timedelta(minutes=86), 60, compute)) == want | {2: 4} and asked[-1] == ["bad"]


class Counted:
    """A service that leaves a file for each call, and refuses some values."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, values):
        Path(self.folder, f"{time.time():.6f}-{os.getpid()}-{random.random()}-{len(values)}").touch()
        if 13 in values:
            raise ConnectionError("no")
        return [v * 2 for v in values] + ([0] if 26 in values else [])


@pytest.mark.parametrize("slots", [1, 3])
def test_pace_holds_over_all_tasks(spark, tmp_path, slots):
    rows = spark.range(60).repartition(9).withColumn("value", F.col("id"))
    folder = tmp_path / "calls"
    folder.mkdir()
    began = time.time()
    done, refused = entries.paced(rows, "id", "value", "twice", "bigint", Counted(str(folder)), per_minute=60 * 20, slots=slots, batch=2, in_flight=3, retries=1, wait=0.01)
    took = time.time() - began
    found, again = {r.id: r.twice for r in done.collect()}, {r.id for r in refused.collect()}
    assert {13, 26} <= again and len(again) <= 4 and set(found) | again == set(range(60)) and all(v == 2 * k for k, v in found.items())
    calls = sorted(float(p.name.split("-")[0]) for p in folder.iterdir())
    asked = sum(int(p.name.rsplit("-", 1)[1]) for p in folder.iterdir())
    # 64 values or so at twenty a second, and a first batch of each slot at once
    assert asked >= 60 + len(again) and calls[-1] - calls[0] >= 0.75 * (asked / slots - 2) / (20 / slots) / 1.34 and took > 2
    # what was refused is what the next run asks for
    spark.range(1).count()
    assert entries.paced(refused.filter("id NOT IN (13, 26)"), "id", "value", "twice", "bigint", Counted(str(folder)), 6e6, retries=0)[1].count() == 0


def test_insights_by_day(spark, tmp_path):
    t = generator.generate(spark, 6000, date(2024, 6, 20), seed=4, persons=60)
    as_of, path = "2024-06-20", str(tmp_path / "daily")
    want = sorted(map(tuple, insights.insights(t, as_of).collect()))
    assert want
    late = F.col("CaseMasterID") % 5 == 0
    first = type(t)({**{k: t[k] for k in t}, "CaseMaster": t["CaseMaster"].filter(~(late & (F.col("CrimeRegisteredDate") >= F.lit(date(2024, 6, 1)))))})
    daily.refresh(first, path, [(date(2023, 12, 1), date(2024, 6, 10))])
    before = {str(p) for p in Path(path).rglob("*.parquet")}
    daily.refresh(t, path, [(date(2024, 6, 1), date(2024, 6, 21))])
    assert sorted(map(tuple, daily.insights_kept(t, path, as_of).collect())) == want
    # days before stay as they are
    after = {str(p) for p in Path(path).rglob("*.parquet")}
    assert {Path(p).parent.name for p in after - before} <= {f"day=2024-06-{d:02}" for d in range(1, 21)}
    assert len(before & after) > 300


def test_updates_rewrite_only_what_they_touch(spark, tmp_path):
    path, rows = str(tmp_path / "stored"), spark.range(500).select("id", F.lit("old").alias("x"))
    upkeep.stored(rows, path, ["id"], 16)
    before = {str(p): p.parent.name for p in Path(path).rglob("*.parquet")}
    upkeep.update_stored(spark, path, spark.createDataFrame([(7, "new"), (9, None), (10**6, "nowhere")], "id bigint, x string"), ["id"], 16)
    after = {str(p): p.parent.name for p in Path(path).rglob("*.parquet")}
    assert {r.id: r.x for r in spark.read.parquet(path).collect()} == {k: "old" for k in range(500)} | {7: "new", 9: None}
    assert set(before.values()) == set(after.values()) and len(set(before.items()) & set(after.items())) >= len(before) - 3
    upkeep.update_stored(spark, path, rows.limit(0), ["id"], 16)
    assert {str(p) for p in Path(path).rglob("*.parquet")} == set(after)


def test_the_gate_lets_no_file_through(spark):
    spark.range(5).createOrReplaceTempView("gated")
    for sql in ("SELECT * FROM text.`secret.txt`", "SELECT * FROM (SELECT * FROM json.`a.json`)", "SELECT (SELECT max(value) FROM csv.`a`) FROM gated", "WITH a AS (SELECT * FROM parquet.`x`) SELECT * FROM a"):
        assert not sqlgate.validate(spark, sql)["valid"], sql
    assert sqlgate.validate(spark, "SELECT g.id FROM gated g")["valid"]


@pytest.mark.parametrize(
    "sql, n",
    [
        ("SELECT id FROM many WHERE id IN (SELECT id FROM many LIMIT 400)", 200), ("SELECT * FROM (SELECT id, count(*) FROM many GROUP BY id)", 200), ("WITH a AS (SELECT id FROM many LIMIT 300) SELECT * FROM a", 200),
        ("SELECT id, count(*) FROM many GROUP BY id", 500), ("SELECT id FROM many LIMIT 300", 300), ("SELECT count(*) FROM many", 1), ("SELECT id FROM many ORDER BY id DESC", 200), ("SELECT id FROM many UNION ALL SELECT id FROM many", 200),
    ],
)
def test_the_cap_holds_outside_of_subqueries(spark, sql, n):
    spark.range(500).createOrReplaceTempView("many")
    assert sqlgate.run(spark, sql).count() == n


def test_ids_leave_grouped_lists():
    drop = sqlgate.without_ungrouped_id
    assert drop("SELECT x, c.CaseMasterID AS id, count(*) AS n FROM t c GROUP BY x, c.CaseMasterID ORDER BY n") == "SELECT x, count(*) AS n FROM t c GROUP BY x ORDER BY n"
    for kept in ("SELECT count(cm.CaseMasterID), x FROM t GROUP BY x", "SELECT CaseMasterID FROM t GROUP BY CaseMasterID", "SELECT a.CaseMasterID, b FROM t", "SELECT 'CaseMasterID', b FROM t GROUP BY b"):
        assert drop(kept) == kept
    assert sqlgate.sanitize("<THINK>a</think>Sure:\n```\nSELECT 'a;b' -- x\n\nmore\n```") == "SELECT 'a;b' -- x"
    assert sqlgate.sanitize("<think>SELECT 1") == "SELECT 1" and sqlgate.sanitize("") == ""


def test_classifier(spark):
    r = random.Random(1)
    rows = [(k, k % 2, k % 2 + r.gauss(0, 0.3), r.choice("ab"), "good words" if k % 2 else "bad words") for k in range(200)] + [(k, None, None, None, None) for k in range(200, 203)]
    df = spark.createDataFrame(rows, "id int, label int, x double, kind string, text string").withColumn("a.b", F.lit(1))
    for parts in ({"numbers": ["x"], "names": ["kind"]}, {"texts": ["text"]}):
        model = classify.fit(df.filter("id % 4 < 2"), "label", **parts)
        told = classify.scored(df, model, **parts)
        assert told.count() == 203 and told.filter("score < 0 OR score > 1 OR predicted <> cast(score >= 0.5 AS int)").isEmpty()
        found = classify.measured(told.filter("id % 4 >= 2"), "label").first()
        assert found.n == 100 and found.accuracy > 0.85 and found.auc > 0.95
    assert classify.measured(told.limit(0), "label").first().auc is None
