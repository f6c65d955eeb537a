"""The gate, display choices, tools, files, generator and stream."""

import json
import re
from datetime import date, datetime

import pytest

from casewright.operators import cases, network
from casewright.plans import items, sqlgate, tools, viz
from casewright.sources import generator, store
from casewright.sources.tables import from_folder
from casewright.streaming import surge

GOOD = [
    "SELECT 1",
    "SELECT a, count(*) FROM t WHERE b > 1 GROUP BY a HAVING count(*) > 2 ORDER BY 2 DESC LIMIT 5",
    "WITH x AS (SELECT 1 AS a) SELECT * FROM x JOIN x y USING (a)",
    "SELECT 1 UNION ALL SELECT 2",
    "SELECT ';' AS semicolon",
    "SELECT a, row_number() OVER (PARTITION BY b ORDER BY c) FROM t WHERE a IN (SELECT a FROM u)",
]
BAD = ["", "-- nothing", "DELETE FROM t", "INSERT INTO t SELECT 1", "DROP TABLE t", "SET a = b", "EXPLAIN SELECT 1", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "WITH a AS (SELECT 1) DELETE FROM t", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM parquet.`/etc/x`", "SELECT (SELECT max(java_method('a', 'b')) FROM t)"]


@pytest.mark.parametrize("sql", GOOD)
def test_reading_passes(spark, sql):
    assert sqlgate.validate(spark, sql) == {"valid": True}


@pytest.mark.parametrize("sql", BAD)
def test_the_rest_does_not(spark, sql):
    assert not sqlgate.validate(spark, sql)["valid"]


def test_sanitize():
    assert sqlgate.sanitize("<think>SELECT no</think>```sql\nSELECT ';' FROM t; -- x\n```") == "SELECT ';' FROM t"
    assert sqlgate.sanitize("Here with care: WITH a AS (SELECT 1) SELECT * FROM a\n\nNote: x") == "WITH a AS (SELECT 1) SELECT * FROM a"
    assert sqlgate.without_ungrouped_id('SELECT cm."CaseMasterID", x, count(*) FROM t GROUP BY cm."CaseMasterID", x') == "SELECT x, count(*) FROM t GROUP BY x"


def test_rows_without_a_limit_are_bounded(spark):
    assert sqlgate.run(spark, "SELECT * FROM range(1000)").count() == 200
    assert sqlgate.run(spark, "SELECT * FROM range(1000) LIMIT 300").count() == 300


def test_display(spark):
    assert viz.classify("select accusedname, count(*) from a group by 1") == "graph"
    assert viz.classify('SELECT "DistrictName" FROM d GROUP BY 1') == "chart"
    assert viz.classify("SELECT country FROM x GROUP BY 1") == "chart" and viz.classify("SELECT 1") == "table"
    pie = spark.createDataFrame([("a", 1)], "name string, n int")
    assert viz.chart(pie) == {"kind": "pie", "label": "name", "values": ["n"]}
    assert viz.chart(pie.withColumnRenamed("name", "month"))["kind"] == "line"
    assert viz.chart(pie.withColumn("m", pie.n))["kind"] == "multi_bar" and viz.chart(pie.limit(0))["kind"] == "none"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("cases"))
    generator.write(generator.generate(spark, 600, date(2024, 5, 31), seed=3, persons=200, crew=60), folder)
    return folder


def test_generated_tables_repeat_and_are_whole(spark, made):
    t = from_folder(spark, made)
    again = generator.generate(spark, 600, date(2024, 5, 31), seed=3, persons=200, crew=60, parts=7)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(t["Accused"]) == key(again["Accused"]) and key(t["CaseMaster"]) == key(again["CaseMaster"])
    assert t["CaseMaster"].count() == 600 and sum(r["count"] for r in cases.district_counts(t).collect()) == 600
    edges = network.edges(t)
    ids = {r.id for r in network.nodes(t, edges).collect()}
    assert ids and all(e.source < e.target and e.weight >= 2 and {e.source, e.target} <= ids for e in edges.collect())


def test_tools(spark, made):
    c = tools.Context(spark, from_folder(spark, made), datetime(2024, 5, 31))
    got = tools.call(c, "queryDatabase", sql='SELECT d."DistrictName", COUNT(*) AS n FROM "CaseMaster" cm JOIN "Unit" u ON u."UnitID" = cm."PoliceStationID" JOIN "District" d ON d."DistrictID" = u."DistrictID" GROUP BY 1 ORDER BY 2 DESC')
    assert got["status"] == "ok" and got["viz"] == "chart" and sum(r.n for r in got["rows"].collect()) == 600
    assert tools.call(c, "queryDatabase", sql="DROP TABLE x")["status"] == "error"
    assert tools.call(c, "getNetworkOrMapData", kind="other")["status"] == "error" and tools.call(c, "nothing")["status"] == "error"
    assert tools.call(c, "predictRisk", has_arrest=True, days=200, heinous=True, victim_count=1, accused_count=2)["rows"].first().probability == 0.625
    for name, arguments in {"searchRelatedCases": {"text": "case reported station"}, "checkInsights": {}, "getProfile": {"which": "offender"}}.items():
        assert tools.call(c, name, **arguments)["rows"].count() >= 0
    kept, n = tools.capped(c.tables["Victim"])
    assert len(kept) == 40 and n == 600


def test_pushdown(spark, made):
    from casewright.operators import insights

    plan = insights.spikes(from_folder(spark, made), "2024-05-31")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(CrimeRegisteredDate", plan)


def test_files(spark, tmp_path):
    path = tmp_path / "examples.json"
    path.write_text(json.dumps([{"question": "b?", "sql": "SELECT 1"}, {"question": "a?", "sql": "SELECT 2"}]))
    assert [tuple(r) for r in store.read_examples(spark, str(path)).orderBy("idx").collect()] == [(0, "b?", "SELECT 1"), (1, "a?", "SELECT 2")]
    df, at, kept = spark.createDataFrame([(1, 'a"b,c\nd'), (2, None)], "id int, s string"), datetime(2024, 1, 1, 12), str(tmp_path / "kept")
    assert store.load_snapshot(spark, kept, at, 180) is None
    assert store.read_through(spark, kept, at, 180, lambda: df).count() == 2
    assert store.load_snapshot(spark, kept, datetime(2024, 1, 1, 15), 180).count() == 2 and store.load_snapshot(spark, kept, datetime(2024, 1, 1, 15, 1), 180) is None
    store.append_audit(spark, str(tmp_path / "audit"), [{"at": at, "run_id": "r", "step": 1, "tool": "x", "args": {"k": 1}, "status": "ok"}])
    store.append_audit(spark, str(tmp_path / "audit"), [{"at": at, "run_id": "s", "step": 1}])
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    store.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r.s for r in back.collect()} == {'a"b,c\nd', None}
    assert [r.n for r in store.enriched(df, "id", "n", "long", lambda xs: [x * 2 for x in xs], batch=1).orderBy("id").collect()] == [2, 4]
    said = list(store.server_sent(store.events(df, "q")))
    assert len(said) == 5 and json.loads(said[-1][6:])["rows"] == 2


def test_stream_counts_like_a_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    source = str(tmp_path / "events")
    rows = [(datetime(2024, 1, 1 + d, 5), "click" if d % 3 else "error") for d in range(28)]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string").repartition(3).write.parquet(source)
    surge.run(surge.weekly(surge.read(spark, source), "40 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    stream = surge.weekly(surge.read(spark, source), "0 seconds")
    surge.run(stream, str(tmp_path / "out2"), str(tmp_path / "check2"))
    closed = spark.read.parquet(str(tmp_path / "out2"))
    batch = spark.read.parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "7 days").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("week_start"), "event_type", "n")
    # windows that the newest event hasn't passed stay open
    assert closed.count() > 0 and closed.exceptAll(batch).isEmpty()


def test_evaluation(spark):
    from casewright.plans import evaluate

    examples = spark.createDataFrame([(0, "count the cases", "SELECT count(*) FROM range(3)"), (1, "list the cases", "SELECT * FROM range(3)")], "idx bigint, question string, sql string")
    said = lambda question, near: near[0]["sql"] if question.startswith("count") else "DROP TABLE x"
    results = evaluate.evaluate(spark, examples, said)
    got = {r.idx: r for r in results.collect()}
    assert got[0].passed and got[0].token_overlap == 1.0 and got[0].top_score == 1.0 and not got[1].passed and "Refused" in got[1].error
    assert evaluate.summary(results).first().passed_percent == 50.0
    held = {r.idx: r for r in evaluate.evaluate(spark, examples, lambda q, near: near[0]["sql"], hold_out=True).collect()}
    assert held[0].generated_sql == "SELECT * FROM range(3)" and held[0].top_score < 1


def test_listed_places(spark):
    from casewright.operators import retrieval

    examples = spark.createDataFrame([(i, f"q{i}") for i in range(5)], "idx int, question string")
    places = lambda answer: [(r.idx, round(r.score, 2)) for r in retrieval.by_listed_places(examples, answer).collect()]
    assert places("best: [3, 9, 1, 3]") == [(3, 1.0), (1, 0.99)]
    assert places("none") == places(None) == places("[77]") == [(0, 1.0), (1, 0.99), (2, 0.98)]


def test_equal_statements_are_read_once(spark, tmp_path, monkeypatch):
    spark.range(500).selectExpr("id AS s_suppkey", "CAST(id % 2 AS INT) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "A{}"), (1, "B'")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    read, validate = [], sqlgate.validate
    monkeypatch.setattr(sqlgate, "validate", lambda spark, sql: (read.append(sql), validate(spark, sql))[1])
    got = {r.k: r.valid for r in items.QUERIES["sql_verdicts"](spark, str(tmp_path)).collect()}
    statements = {k: items._STATEMENTS[k % 11][0].format(("A{}", "B'")[k % 2]) for k in range(500)}
    assert got == {k: validate(spark, s)["valid"] for k, s in statements.items()} and sorted(read) == sorted(set(statements.values()))
    shown = {r.k: r.shown for r in items.QUERIES["viz_choice"](spark, str(tmp_path)).collect()}
    assert shown == {k: viz.classify(s) for k, s in statements.items()}
