"""Further queries over the star-schema tables, one for each operation that the others don't show, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import columns as C
from casewright.operators import cases, classify, daily, filters, insights, names, nearest, network, retrieval, risk, search, upkeep, vectors
from casewright.plans import evaluate, sqlgate, star, tools, viz
from casewright.sources import entries, generator, store
from casewright.sources.tables import Tables, from_star, star_sql
from casewright.streaming import surge

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}
NOW = datetime(2024, 1, 1)


def _add(name: str, sql: str, tables: str = "") -> Callable[[Q], Q]:
    def put(query: Q) -> Q:
        QUERIES[name], SQL[name] = query, (star_sql(*tables.split()) if tables else "") + sql
        return query

    return put


def _cases(name: str, sql: str, tables: str) -> Callable[[Callable[[Tables], DataFrame]], object]:
    return lambda build: _add(name, sql, tables)(lambda spark, folder: build(from_star(spark, folder)))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _values(columns: str, rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({columns})"


# SQL given as text

_COUNTS = "SELECT d.DistrictName AS name, count(*) AS count FROM CaseMaster cm JOIN Unit u ON u.UnitID = cm.PoliceStationID JOIN District d ON d.DistrictID = u.DistrictID GROUP BY 1"


@_cases("sql_gate", "SELECT CrimeMajorHeadID AS head, count(*) AS n FROM CaseMaster WHERE CaseStatusID = 2 GROUP BY 1", "CaseMaster")
def _gate(t: Tables) -> DataFrame:
    t.register()
    return sqlgate.run(t["CaseMaster"].sparkSession, "SELECT CrimeMajorHeadID AS head, count(*) AS n FROM CaseMaster WHERE CaseStatusID = 2 GROUP BY 1")


@_cases("sql_gate_rows", "SELECT CaseMasterID, CrimeNo FROM CaseMaster ORDER BY CaseMasterID DESC LIMIT 200", "CaseMaster")
def _gate_rows(t: Tables) -> DataFrame:
    t.register()
    return sqlgate.run(t["CaseMaster"].sparkSession, "WITH c AS (SELECT CaseMasterID, CrimeNo FROM CaseMaster) SELECT * FROM c ORDER BY CaseMasterID DESC")


@_cases("sql_tool", "SELECT CaseStatusID, count(*) AS n FROM CaseMaster GROUP BY 1", "CaseMaster")
def _tool(t: Tables) -> DataFrame:
    said = '<think>SELECT nothing</think>Here it is:\n```sql\nSELECT cm."CaseMasterID", cm.CaseStatusID, count(*) AS n FROM CaseMaster cm GROUP BY cm.CaseStatusID; DROP TABLE CaseMaster\n```'
    answer = tools.call(tools.Context(t["CaseMaster"].sparkSession, t, NOW), "queryDatabase", sql=said)
    if answer["status"] != "ok":
        raise RuntimeError(answer["message"])
    return answer["rows"]


#: Statements about a name, whether the gate lets them through, and how their results are shown.
_STATEMENTS = [
    ("SELECT count(*) FROM CaseMaster WHERE DistrictName = '{}'", True, "table"),
    ("WITH a AS (SELECT '{}' AS x) SELECT * FROM a UNION SELECT 'y'", True, "table"),
    ("DROP TABLE {}", False, "table"),
    ("WITH a AS (SELECT 1) DELETE FROM CaseMaster WHERE x = '{}'", False, "table"),
    ("SELECT '{}'; SELECT 2", False, "table"),
    ("SELECT ';' AS x, count(*) FROM CaseMaster WHERE x <> '{}' GROUP BY DistrictName", True, "chart"),
    ("INSERT INTO CaseMaster SELECT '{}'", False, "table"),
    ("-- {}", False, "table"),
    ("SELECT AccusedName, count(*) FROM Accused WHERE x = '{}' GROUP BY AccusedName", True, "graph"),
    ("SELECT reflect('java.lang.System', '{}')", False, "table"),
    ("SELECT * FROM text.`{}`", False, "table"),
]


def _statements(spark: SparkSession, folder: str) -> DataFrame:
    """k, statement: one for each supplier of a nation."""
    rows = _table(spark, folder, "supplier").join(_table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    forms = F.array(*[F.lit(form) for form, _, _ in _STATEMENTS])
    return rows.select(F.col("s_suppkey").alias("k"), F.replace(F.get(forms, F.pmod("s_suppkey", F.lit(len(_STATEMENTS))).cast("int")), F.lit("{}"), F.col("n_name")).alias("statement"))


_OF_STATEMENT = "SELECT s_suppkey AS k, ({})[(s_suppkey % 11)::INT + 1] AS {} FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@_add("sql_verdicts", _OF_STATEMENT.format([valid for _, valid, _ in _STATEMENTS], "valid"))
def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _statements(spark, folder)
    return rows.join(sqlgate.verdicts(rows, "statement"), "statement").select("k", "valid")


@_add("viz_choice", _OF_STATEMENT.format([shown for _, _, shown in _STATEMENTS], "shown"))
def _viz(spark: SparkSession, folder: str) -> DataFrame:
    rows = _statements(spark, folder)
    return rows.join(viz.classified(rows, "statement"), "statement").select("k", "shown")


@_add("chart_choice", _values("k, kind, label", [(0, "bar", "name"), (1, "line", "month"), (2, "pie", "crime_type"), (3, "none", None), (4, "multi_bar", "crime_type")]))
def _chart(spark: SparkSession, folder: str) -> DataFrame:
    t = from_star(spark, folder)
    shown = [
        cases.district_counts(t),
        t["CaseMaster"].groupBy(F.date_format("CrimeRegisteredDate", "yyyy-MM").alias("month")).count(),
        star.QUERIES["events_weekly_counts"](spark, folder).select("crime_type", "this_week"),
        t["CaseMaster"].limit(0),
        star.QUERIES["events_weekly_counts"](spark, folder),
    ]
    return spark.createDataFrame([(k, c["kind"], c["label"]) for k, c in enumerate(map(viz.chart, shown))], "k int, kind string, label string")


# files around the tables


@_add("examples_file", "SELECT row_number() OVER (ORDER BY n_nationkey)::INT - 1 AS idx, 'How many in ' || n_name || '?' AS question, 'SELECT ' || n_nationkey AS sql FROM nation")
def _examples_file(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "nation").orderBy("n_nationkey").collect()
    path = store.scratch(spark, "examples")
    spark.createDataFrame([(json.dumps([{"question": f"How many in {r.n_name}?", "sql": f"SELECT {r.n_nationkey}"} for r in rows]),)], "value string").coalesce(1).write.text(path)
    return store.read_examples(spark, path)


@_cases("snapshot_kept", _COUNTS, "CaseMaster Unit District")
def _snapshot(t: Tables) -> DataFrame:
    spark, found = t["CaseMaster"].sparkSession, cases.district_counts(t)
    path = store.scratch(spark, "snapshot")
    store.read_through(spark, path, NOW, 180, lambda: found)
    # the second reader gets what the first kept
    return store.read_through(spark, path, NOW + timedelta(minutes=170), 180, lambda: found.limit(0))


@_cases("snapshot_renewed", _COUNTS, "CaseMaster Unit District")
def _renewed(t: Tables) -> DataFrame:
    spark, found = t["CaseMaster"].sparkSession, cases.district_counts(t)
    path = store.scratch(spark, "snapshot")
    store.save_snapshot(found.limit(3), path, NOW)
    return store.read_through(spark, path, NOW + timedelta(minutes=190), 180, lambda: found)


@_add("embedding_cache", "SELECT vec_id, label FROM embeddings")
def _embedding_cache(spark: SparkSession, folder: str) -> DataFrame:
    path = store.scratch(spark, "vectors")
    store.save_snapshot(_table(spark, folder, "embeddings"), path, NOW)
    kept = store.load_snapshot(spark, path, NOW + timedelta(minutes=10_080), 10_080)
    return kept.select("vec_id", "label")


def _audit(format: str) -> Q:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        """Every event as the record of a step, appended in two goes."""
        path, rows = store.scratch(spark, "audit"), _table(spark, folder, "events")
        failed = F.col("event_type") == "error"
        records = rows.select(
            F.col("ts").cast("timestamp_ntz").alias("at"), F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("int").alias("step"), F.col("event_type").alias("tool"), F.col("props").alias("args"),
            F.when(failed, "error").otherwise("ok").alias("status"), F.when(~failed, F.floor("value").cast("bigint")).alias("row_count"), F.when(failed, F.concat(F.lit("failed: "), "props")).alias("error"),
        )
        for part in (records.filter("step % 3 = 0"), records.filter("step % 3 <> 0")):
            store.append_records(part, path, format)
        return spark.read.schema(store.AUDIT).format(format).load(path).select("run_id", "step", "tool", "status", "row_count", "error", F.get_json_object("args", "$.k").cast("int").alias("k"))

    return query


for _format in ("json", "parquet"):
    _add(
        f"audit_{_format}",
        "SELECT user_id::VARCHAR AS run_id, event_id::INT AS step, event_type AS tool, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT END AS row_count, "
        "CASE WHEN event_type = 'error' THEN 'failed: ' || props END AS error, json_extract_string(props, '$.k')::INT AS k FROM events",
    )(_audit(_format))


@_cases("csv_export", _COUNTS, "CaseMaster Unit District")
def _csv(t: Tables) -> DataFrame:
    spark = t["CaseMaster"].sparkSession
    path = store.scratch(spark, "csv")
    store.export_csv(cases.district_counts(t), path)
    return spark.read.schema("name string, count bigint").option("header", True).csv(path)


@_cases("printed_rows", "SELECT CaseMasterID, CrimeNo FROM CaseMaster ORDER BY CaseMasterID LIMIT 100", "CaseMaster")
def _printed(t: Tables) -> DataFrame:
    return store.for_print(t["CaseMaster"].select("CaseMasterID", "CrimeNo").orderBy("CaseMasterID"))


@_cases("event_stream", "SELECT type, count(*) AS n, max(rows) AS rows FROM (SELECT unnest(['step', 'meta']) AS type, NULL AS rows UNION ALL SELECT 'done', (SELECT count(*) FROM (" + _COUNTS + ")) UNION ALL SELECT 'row', NULL FROM (" + _COUNTS + ")) GROUP BY 1", "CaseMaster Unit District")
def _stream(t: Tables) -> DataFrame:
    """A result's events, written as lines and read back."""
    spark, path = t["CaseMaster"].sparkSession, store.scratch(t["CaseMaster"].sparkSession, "events")
    store.event_lines(cases.district_counts(t), "?").select("data").write.text(path)
    told = spark.read.text(path).select(F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.rows").cast("bigint").alias("rows"))
    return told.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("rows"))


def _answered(t: Tables, tool: str, **arguments: object) -> DataFrame:
    answer = tools.call(tools.Context(t["CaseMaster"].sparkSession, t, datetime.fromisoformat(star.AS_OF)), tool, **arguments)
    if answer["status"] != "ok":
        raise RuntimeError(answer["message"])
    return answer["rows"]


for _name, _same, _tool, _arguments in (("tool_insights", "insights", "checkInsights", {}), ("tool_map", "district_counts", "getNetworkOrMapData", {"kind": "map"}), ("tool_network", "network_edges", "getNetworkOrMapData", {"kind": "network"})):
    QUERIES[_name] = lambda spark, folder, tool=_tool, arguments=_arguments: _answered(from_star(spark, folder), tool, **arguments)
    SQL[_name] = star.SQL[_same]


class _Lengths:
    """A service that refuses each worker's first call."""

    def __init__(self):
        self.asked = 0

    def __call__(self, values: list) -> list:
        self.asked += 1
        if self.asked == 1:
            raise ConnectionError("too many requests")
        return [len(v) for v in values]


@_add("enriched_parts", "SELECT p_partkey, length(p_name)::BIGINT AS n FROM part")
def _enriched(spark: SparkSession, folder: str) -> DataFrame:
    return store.enriched(_table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", "n", "bigint", _Lengths(), wait=0.01, per_minute=6e6).select("p_partkey", "n")


@_add("generated_cases", "SELECT name, n FROM (SELECT count(*) AS c FROM orders) CROSS JOIN LATERAL (VALUES ('CaseMaster', c), ('ComplainantDetails', c), ('District', 30), ('Unit', 210), ('Victim', c)) v(name, n)")
def _generated(spark: SparkSession, folder: str) -> DataFrame:
    """As many cases as there are orders."""
    made = generator.generate(spark, _table(spark, folder, "orders").count(), date(2024, 1, 1), seed=3)
    counts = [made[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in ("CaseMaster", "ComplainantDetails", "District", "Unit", "Victim")]
    found = counts[0]
    for x in counts[1:]:
        found = found.unionAll(x)
    return found


@_add("generated_weights", "SELECT k::INT AS k, true AS near FROM range(1, 9) t(k) WHERE (SELECT count(*) FROM orders) > 0")
def _weights(spark: SparkSession, folder: str) -> DataFrame:
    """Of as many cases as there are orders, each group's share must be within five standard errors of its weight."""
    n, weights = _table(spark, folder, "orders").count(), [w for w, _ in generator.GROUPS.values()]
    shares = generator.generate(spark, n, date(2024, 1, 1), seed=5)["CaseMaster"].groupBy(F.col("CrimeMajorHeadID").cast("int").alias("k")).agg((F.count(F.lit(1)) / n).alias("share"))
    wanted = spark.createDataFrame([(k + 1, w / sum(weights)) for k, w in enumerate(weights)], "k int, wanted double")
    return wanted.join(shares, "k").select("k", (F.abs(F.col("share") - F.col("wanted")) < 5 * F.sqrt(F.col("wanted") * (1 - F.col("wanted")) / n)).alias("near"))


# changes


@_add("numbered_rows", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) + 99 AS row_id FROM customer")
def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    return upkeep.with_ids(_table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "row_id", ["c_mktsegment", "c_custkey"], 100).select("c_custkey", "row_id")


@_add("inserted_once", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0")
def _inserted(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "customer").select("c_custkey", "c_name")
    new = rows.withColumn("c_name", F.lit("new"))
    return upkeep.insert_new(rows.filter("c_custkey % 3 > 0"), new.unionAll(new), ["c_custkey"])


@_add("upserted", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0")
def _upserted(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "customer").select("c_custkey", "c_name")
    return upkeep.upsert(rows.filter("c_custkey % 3 > 0"), rows.filter("c_custkey % 2 = 0").withColumn("c_name", F.lit("new")), ["c_custkey"])


_REFERENCES = {"Accused": ["CaseMaster"], "ArrestSurrender": ["CaseMaster", "Accused"], "CaseMaster": ["Unit"], "Unit": ["District"]}


@_cases("truncated_tables", "SELECT 'ArrestSurrender' AS name, 0 AS n UNION ALL SELECT 'Accused', 0 UNION ALL SELECT 'CaseMaster', 0 UNION ALL SELECT 'Unit', count(*) FROM Unit UNION ALL SELECT 'District', count(*) FROM District", "Unit District")
def _truncated(t: Tables) -> DataFrame:
    left = upkeep.truncated({name: t[name] for name in ("ArrestSurrender", "Accused", "CaseMaster", "Unit", "District")}, ["CaseMaster"], _REFERENCES)
    found = None
    for name, df in left.items():
        n = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        found = n if found is None else found.unionAll(n)
    return found


@_cases("deleted_with_dependents", "SELECT CaseMasterID, AccusedMasterID FROM Accused WHERE CaseMasterID % 4 > 0 AND CaseMasterID IN (SELECT CaseMasterID FROM CaseMaster)", "CaseMaster Accused")
def _deleted(t: Tables) -> DataFrame:
    parent, child = upkeep.delete_with_dependents(t["CaseMaster"], t["Accused"], t["CaseMaster"].filter("CaseMasterID % 4 = 0"), "CaseMasterID", "CaseMasterID")
    return child.join(parent.select("CaseMasterID"), "CaseMasterID").select("CaseMasterID", "AccusedMasterID")


@_cases("backfill_batch", "SELECT CaseMasterID FROM CaseMaster WHERE latitude IS NULL AND BriefFacts IS NOT NULL ORDER BY CaseMasterID LIMIT 90", "CaseMaster")
def _backfill(t: Tables) -> DataFrame:
    return upkeep.to_backfill(t["CaseMaster"], "CaseMasterID", "BriefFacts", "latitude", 90).select("CaseMasterID")


@_add("zipped_rows", "SELECT a.p AS place, c_name, s_name FROM (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) a JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier) b USING (p)")
def _zipped(spark: SparkSession, folder: str) -> DataFrame:
    return upkeep.zipped(_table(spark, folder, "customer").select("c_custkey", "c_name"), _table(spark, folder, "supplier").select("s_suppkey", "s_name"), ["c_custkey"], ["s_suppkey"]).select("place", "c_name", "s_name")


@_add("merged_results", "SELECT c_custkey, c_name, min(o_totalprice) AS told FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def _merged(spark: SparkSession, folder: str) -> DataFrame:
    told = _table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("told"))
    return upkeep.merged_by_id(_table(spark, folder, "customer").select("c_custkey", "c_name"), told, "c_custkey")


@_add("history_window", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6")
def _history(spark: SparkSession, folder: str) -> DataFrame:
    return upkeep.history(_table(spark, folder, "conversations"), 6, "conv_id", ["turn"]).select("conv_id", "turn", "role")


# columns


@_cases("chargesheet_kinds", "SELECT CASE cstype WHEN 'A' THEN 'Chargesheet Filed' WHEN 'B' THEN 'False Case' WHEN 'C' THEN 'Undetected' ELSE cstype END AS kind, count(*) AS n FROM (SELECT CASE WHEN CSID % 7 = 0 THEN 'X' ELSE cstype END AS cstype FROM ChargesheetDetails) GROUP BY 1", "ChargesheetDetails")
def _kinds(t: Tables) -> DataFrame:
    rows = t["ChargesheetDetails"].select(F.when(F.col("CSID") % 7 == 0, "X").otherwise(F.col("cstype")).alias("cstype"))
    return rows.groupBy(C.chargesheet_type(F.col("cstype")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@_add("short_labels", "SELECT p_partkey, CASE WHEN length(p_type || ' ' || p_name) > 14 THEN left(p_type || ' ' || p_name, 13) || '…' ELSE p_type || ' ' || p_name END AS label FROM part")
def _short(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "part").select("p_partkey", C.shortened(F.concat_ws(" ", "p_type", "p_name")).alias("label"))


@_cases("case_numbers", "SELECT CaseMasterID, '1' || lpad(PoliceStationID::VARCHAR, 4, '0') || lpad(CrimeMajorHeadID::VARCHAR, 4, '0') || year(CrimeRegisteredDate) || lpad((CaseMasterID % 100000)::VARCHAR, 5, '0') AS number FROM CaseMaster", "CaseMaster")
def _numbers(t: Tables) -> DataFrame:
    number = F.concat(F.lit("1"), C.padded(F.col("PoliceStationID"), 4), C.padded(F.col("CrimeMajorHeadID"), 4), F.year("CrimeRegisteredDate").cast("string"), C.padded(F.col("CaseMasterID") % 100000, 5))
    return t["CaseMaster"].select("CaseMasterID", number.alias("number"))


@_cases("thousands", "SELECT CaseStatusID, format('{:,}', sum(CaseMasterID)::BIGINT) AS shown FROM CaseMaster GROUP BY 1", "CaseMaster")
def _thousands(t: Tables) -> DataFrame:
    return t["CaseMaster"].groupBy("CaseStatusID").agg(C.thousands(F.sum("CaseMasterID")).alias("shown"))


# retrieval

_ASKED = "and the thing that was there"


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("text").alias("question"))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, list[float]]:
    rows = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("idx"), "embedding", F.col("label").cast("string").alias("question"))
    return rows, rows.filter("idx = 0").first()["embedding"]


def _no_service(_: str) -> list[float]:
    raise ConnectionError("no service")


_EXAMPLES_SQL = star.SQL["retrieval_examples"]
_NEAREST = "SELECT e.vec_id AS idx, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q {where} ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT {k}"


@_add("examples_held_out", _EXAMPLES_SQL.replace("WHERE role = 'user'", "WHERE role = 'user' AND conv_id * 1000 + turn <> 0"))
def _held_out(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.similar_examples(_questions(spark, folder), _ASKED, 10, exclude=0).select("idx", F.round("score", 9).alias("score"))


@_add("examples_by_vector", _NEAREST.format(where="WHERE e.vec_id <> 0", k=3))
def _by_vector(spark: SparkSession, folder: str) -> DataFrame:
    rows, asked = _vectors(spark, folder)
    return retrieval.similar_examples_by_vector(rows.select("idx", "question"), rows, asked, 3, exclude=0).select("idx", F.round("score", 6).alias("score"))


@_add("examples_routed", _NEAREST.format(where="", k=2))
def _routed(spark: SparkSession, folder: str) -> DataFrame:
    rows, asked = _vectors(spark, folder)
    return retrieval.routed_examples(rows.select("idx", "question"), rows, "anything", 2, lambda _: asked).select("idx", F.round("score", 6).alias("score"))


@_add("examples_routed_to_words", _EXAMPLES_SQL.replace("LIMIT 10", "LIMIT 2"))
def _routed_words(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.routed_examples(_questions(spark, folder), _vectors(spark, folder)[0], _ASKED, 2, _no_service).select("idx", F.round("score", 9).alias("score"))


@_add("examples_listed", "SELECT idx, score::DOUBLE AS score FROM (VALUES (3, 1.0), (1, 0.99), (7, 0.98)) v(idx, score)")
def _listed(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("question"))
    return retrieval.by_listed_places(rows, "These fit: [3, 1, 3, 99999, 7]", 3).select("idx", F.round("score", 6).alias("score"))


@_add("hybrid_by_vector", _NEAREST.format(where="", k=5))
def _hybrid(spark: SparkSession, folder: str) -> DataFrame:
    rows, asked = _vectors(spark, folder)
    return retrieval.similar(rows, "anything", 5, lambda _: asked, "question", "embedding", "idx").select("idx", F.round("score", 6).alias("score"))


@_add("hybrid_by_words", star.SQL["retrieval_words"])
def _hybrid_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "documents").select("doc_id", "text")
    return retrieval.similar(rows, star.WORDS, 20, _no_service, "text", id_col="doc_id").select("doc_id", F.round("score", 9).alias("score"))


# graphs, classes, caps


@_add("network_hubs", star.SQL["network_nodes"].replace("SELECT e.id, coalesce(max(a.AccusedName), e.id) AS name", "SELECT e.id, max(e.degree) >= 3 AS hub, coalesce(max(a.AccusedName), e.id) AS name"))
def _hubs(spark: SparkSession, folder: str) -> DataFrame:
    return network.flagged(star.QUERIES["network_nodes"](spark, folder))


_SHOWN = star._REPEAT.replace("LIMIT 2", "LIMIT 80")


@_cases(
    "galaxy_nodes",
    f"""SELECT id, label, kind, count, crime_types, priority FROM (
  SELECT accused_name AS id, array_to_string(string_split(accused_name, ' ')[1:2], ' ') AS label, 'accused' AS kind, case_count::DOUBLE AS count, crime_types, (row_number() OVER (ORDER BY case_count DESC, accused_name) <= 10)::INT AS priority FROM ({_SHOWN})
  UNION ALL SELECT DISTINCT 'crime_' || hub, hub, 'crime', NULL::DOUBLE, NULL, 0 FROM (SELECT unnest(string_split(crime_types, ', ')) AS hub FROM ({_SHOWN})))""",
    "Accused CaseMaster CrimeHead",
)
def _galaxy_nodes(t: Tables) -> DataFrame:
    return network.galaxy(insights.repeat_accused(t, star.AS_OF, days=365, top=80), [F.desc("case_count"), F.col("accused_name")])[0]


@_add("likeliest_status", "SELECT o_custkey, o_orderstatus AS label FROM (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) AS k FROM orders GROUP BY 1, 2) WHERE k = 1")
def _likeliest(spark: SparkSession, folder: str) -> DataFrame:
    counts = _table(spark, folder, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    by_customer = counts.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("chances"))
    return risk.likeliest_class(by_customer, "chances").select("o_custkey", "label")


def _classes(values: list) -> list:
    """A stand-in for a remote classifier of features in JSON."""
    found = []
    for v in values:
        p = 0.9 if json.loads(v)["CaseStatusID"] == "3" else 0.5 if json.loads(v)["GravityOffenceID"] == "1" else 0.2
        found.append({"No": 1 - p, "Yes": p})
    return found


@_cases("classified_cases", "SELECT CaseMasterID, CASE WHEN CaseStatusID = 3 THEN 'Yes' ELSE 'No' END AS label FROM CaseMaster", "CaseMaster")
def _classified(t: Tables) -> DataFrame:
    features = ["CaseCategoryID", "GravityOffenceID", "CrimeMajorHeadID", "CrimeMinorHeadID", "CaseStatusID", "CourtID", "PoliceStationID"]
    return risk.classified(t["CaseMaster"].select("CaseMasterID", *features), features, _classes).select("CaseMasterID", "label")


@_cases("capped_rows", "SELECT least(count(*), 40) AS shown, CASE WHEN count(*) > 40 THEN count(*) END AS of_all FROM CaseMaster", "CaseMaster")
def _capped(t: Tables) -> DataFrame:
    rows, total = tools.capped(t["CaseMaster"].select("CaseMasterID").orderBy("CaseMasterID"))
    return t["CaseMaster"].sparkSession.createDataFrame([(len(rows), total)], "shown bigint, of_all bigint")


_SETS = """WITH s AS (SELECT conv_id * 1000 + turn AS idx, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: length(x) >= 3)) AS a FROM conversations WHERE role = 'user'),
p AS (SELECT q.idx AS query, s.idx, len(list_intersect(q.a, s.a)) AS common, len(q.a) + len(s.a) AS total FROM s q, s WHERE q.idx < {below} AND q.idx <> s.idx),
v AS (SELECT query, idx, CASE WHEN total > common THEN common / (total - common) ELSE 0.0 END AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, idx) AS place FROM v)
"""


@_add("examples_nearest", _SETS.format(below=60_000) + "SELECT query, idx, round(score, 9) AS score, place::INT AS place FROM r WHERE place <= 5")
def _nearest_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The first sixty conversations' questions against all questions."""
    rows = _questions(spark, folder)
    asked = rows.filter("idx < 60000").withColumnRenamed("idx", "query")
    return nearest.nearest_examples(rows, asked, 5, hold_out=True).select("query", "idx", F.round("score", 9).alias("score"), "place")


@_add("evaluation", _SETS.format(below=20_000) + "SELECT count(*) AS questions, round(100.0 * count(*) FILTER (idx // 1000 % 3 < 2) / count(*))::DOUBLE AS passed_percent, round(avg(score), 6) AS top_score FROM r WHERE place = 1")
def _evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty conversations' questions, answered by what the nearest other question's statement is; every third is refused."""
    rows = _questions(spark, folder).withColumn("sql", F.expr("CASE WHEN idx DIV 1000 % 3 < 2 THEN concat('SELECT ', idx, ' AS x') ELSE 'DROP TABLE x' END"))
    told = evaluate.evaluate(spark, rows, lambda question, near: near[0]["sql"], hold_out=True, questions=rows.filter("idx < 20000"))
    return evaluate.summary(told).select("questions", "passed_percent", F.round("top_score", 6).alias("top_score"))


# conditions


@_cases("aggregate_row", "SELECT count(*) AS _count, round(avg(AgeYear), 6) AS _avg_AgeYear, sum(AgeYear) AS _sum_AgeYear, min(AgeYear) AS _min_AgeYear, max(AgeYear) AS _max_AgeYear FROM Accused WHERE GenderID = 1", "Accused")
def _aggregate(t: Tables) -> DataFrame:
    return filters.aggregate(t["Accused"], {"GenderID": 1}, _count=True, _avg=["AgeYear"], _sum=["AgeYear"], _min=["AgeYear"], _max=["AgeYear"]).withColumn("_avg_AgeYear", F.round("_avg_AgeYear", 6))


@_cases("relation_counts", "SELECT cm.CaseMasterID, count(a.CaseMasterID) AS accused FROM CaseMaster cm LEFT JOIN Accused a ON a.CaseMasterID = cm.CaseMasterID GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", "CaseMaster Accused")
def _relation_counts(t: Tables) -> DataFrame:
    counted = filters.with_count(t["CaseMaster"].select("CaseMasterID"), t["Accused"], "CaseMasterID", "CaseMasterID", "accused")
    return filters.find_many(counted, order_by=[{"accused": "desc"}, {"CaseMasterID": "asc"}], take=50)


@_cases("filter_nullable", "SELECT CaseMasterID FROM CaseMaster WHERE latitude IS NULL AND CrimeNo IS NOT NULL", "CaseMaster")
def _nullable(t: Tables) -> DataFrame:
    return filters.find_many(t["CaseMaster"], {"latitude": None, "CrimeNo": {"not": None}}, select=["CaseMasterID"])


@_cases("filter_boolean", "SELECT AccusedMasterID FROM Accused WHERE AgeYear < 18 AND NOT (GenderID = 2)", "Accused")
def _boolean(t: Tables) -> DataFrame:
    rows = t["Accused"].withColumn("minor", F.col("AgeYear") < 18).withColumn("female", F.col("GenderID") == 2)
    return filters.find_many(rows, {"minor": True, "female": {"not": True}}, select=["AccusedMasterID"])


@_cases("filter_datetime", "SELECT CSID FROM ChargesheetDetails WHERE csdate >= TIMESTAMP '1999-02-01 00:00:00' AND csdate < TIMESTAMP '1999-04-15 12:00:00'", "ChargesheetDetails")
def _datetime(t: Tables) -> DataFrame:
    return filters.find_many(t["ChargesheetDetails"], {"csdate": {"gte": F.lit("1999-02-01 00:00:00").cast("timestamp_ntz"), "lt": F.lit("1999-04-15 12:00:00").cast("timestamp_ntz")}}, select=["CSID"])


@_add("filter_decimal", "SELECT o_orderkey FROM orders WHERE o_totalprice::DECIMAL(18, 2) >= 1000.10 AND o_totalprice::DECIMAL(18, 2) < 50000.00 AND NOT (o_totalprice::DECIMAL(18, 2) IN (2000.00))")
def _decimal(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    return filters.find_many(rows, {"price": {"gte": Decimal("1000.10"), "lt": Decimal("50000.00"), "notIn": [Decimal("2000.00")]}}, select=["o_orderkey"])


@_add("filter_json", "SELECT event_id FROM events WHERE (props->>'k') IN ('3', '5') AND event_type = 'click'")
def _json(spark: SparkSession, folder: str) -> DataFrame:
    return filters.find_many(_table(spark, folder, "events"), {"props": {"path": ["k"], "in": ["3", "5"]}, "event_type": "click"}, select=["event_id"])


# streaming


@_add(
    "stream_weekly_counts",
    """SELECT week_start, event_type, count(*) AS n FROM (SELECT *, make_timestamp((floor(epoch(ts) / 604800) * 604800 * 1000000)::BIGINT) AS week_start FROM events)
WHERE week_start + INTERVAL '7 days' <= (SELECT max(ts) - INTERVAL '1 day' FROM events) GROUP BY ALL""",
)
def _weekly(spark: SparkSession, folder: str) -> DataFrame:
    path = store.scratch(spark, "weekly")
    surge.run(surge.weekly(surge.read(spark, f"{folder}/[e]vents.parquet")), path, f"{path}-state")
    return spark.read.parquet(path).withColumn("week_start", F.col("week_start").cast("timestamp_ntz"))


@_cases("sql_gate_subquery", "SELECT CaseMasterID FROM CaseMaster ORDER BY CaseMasterID LIMIT 200", "CaseMaster")
def _gate_subquery(t: Tables) -> DataFrame:
    t.register()
    return sqlgate.run(t["CaseMaster"].sparkSession, "SELECT CaseMasterID FROM CaseMaster WHERE CaseMasterID IN (SELECT CaseMasterID FROM CaseMaster ORDER BY CaseMasterID LIMIT 4000) ORDER BY CaseMasterID")


_ROLLING = """WITH d AS (SELECT unnest(generate_series(date_trunc('day', (SELECT min(ts) FROM events)) + INTERVAL '1 day', date_trunc('day', (SELECT max(ts) FROM events)), INTERVAL '1 day')) AS until),
c AS (SELECT until, event_type, count(*) FILTER (ts >= until - INTERVAL '7 days') AS this_week, count(*) FILTER (ts < until - INTERVAL '7 days') AS last_week FROM d JOIN events ON ts >= until - INTERVAL '14 days' AND ts < until
WHERE until <= (SELECT max(ts) - INTERVAL '1 day' FROM events) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY until ORDER BY this_week DESC, event_type) AS place FROM c)
"""


def _rolled(spark: SparkSession, folder: str) -> DataFrame:
    path = store.scratch(spark, "rolling")
    surge.run(surge.rolling(surge.read(spark, f"{folder}/[e]vents.parquet")), path, f"{path}-state")
    return spark.read.parquet(path).withColumn("until", F.col("until").cast("timestamp_ntz"))


_add("stream_rolling", _ROLLING + "SELECT until, event_type, this_week, last_week FROM c")(_rolled)


@_add("stream_surge", _ROLLING + "SELECT until, event_type, this_week, last_week FROM r WHERE place = 1 AND this_week > 5 AND this_week > last_week * 1.3")
def _stream_surge(spark: SparkSession, folder: str) -> DataFrame:
    return surge.surges(_rolled(spark, folder))


@_add("insights_incremental", star.SQL["insights"])
def _incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Half a year up to ten days before is kept first; then the ten new days are added, and a stretch with late rows is counted anew."""
    t, path, end = from_star(spark, folder), store.scratch(spark, "daily"), date.fromisoformat(star.AS_OF[:10])
    new, late = end - timedelta(days=10), end - timedelta(days=40)
    part = Tables({**{k: t[k] for k in t}, "CaseMaster": t["CaseMaster"].filter(~((F.col("CrimeRegisteredDate") >= F.lit(late)) & (F.col("CaseMasterID") % 7 == 0)))})
    daily.refresh(part, path, [(end - timedelta(days=215), new)])
    daily.refresh(t, path, [(late, new), (new, end + timedelta(days=32))])
    return daily.insights_kept(t, path, star.AS_OF)


# entries of a cache, calls at a pace, names


@_add("cache_by_entry", "WITH n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END AS text FROM documents) SELECT doc_id, length(text)::BIGINT AS n, text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL) AS computed FROM n")
def _cache_by_entry(spark: SparkSession, folder: str) -> DataFrame:
    """All texts are computed and kept; the second run, with a tenth of the texts changed, computes only what it doesn't have."""
    path, docs = store.scratch(spark, "entries"), _table(spark, folder, "documents").select("doc_id", "text")
    measured = lambda run: lambda texts: texts.select("hash", F.struct(F.length("text").cast("bigint").alias("n"), F.lit(run).alias("run")).alias("value"))
    entries.through(docs, "text", "kept", path, NOW, 60, measured(1))
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    found = entries.through(changed, "text", "kept", path, NOW + timedelta(minutes=30), 60, measured(2))
    return found.select("doc_id", F.col("kept.n").alias("n"), (F.col("kept.run") == 2).alias("computed"))


@_add("paced_parts", "SELECT p_partkey, CASE WHEN p_partkey % 500 <> 7 THEN length(p_name)::BIGINT END AS n FROM part")
def _paced(spark: SparkSession, folder: str) -> DataFrame:
    """Some values are refused in the first run and null then; all others get theirs."""
    rows = _table(spark, folder, "part").select("p_partkey", F.when(F.col("p_partkey") % 500 != 7, F.col("p_name")).alias("p_name"))
    done, refused = entries.paced(rows, "p_partkey", "p_name", "n", "bigint", _Measured(), 6e7, batch=1, retries=0, in_flight=4)
    return done.unionByName(refused.select("p_partkey", F.lit(None).cast("bigint").alias("n")))


class _Measured:
    """A service that can't take nulls."""

    def __call__(self, values: list) -> list:
        return [len(v) for v in values]


@_add("names_within", "SELECT p_partkey, c_custkey FROM part JOIN customer ON contains(c_name, lpad(p_partkey::VARCHAR, 5, '0'))")
def _names_within(spark: SparkSession, folder: str) -> DataFrame:
    """Which customers' names hold a part's number."""
    parts = _table(spark, folder, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 5, "0").alias("number"))
    customers = _table(spark, folder, "customer").select("c_custkey", "c_name")
    pairs = names.holding(parts, customers, "number", "c_name")
    # both tables are larger than their files tell, and a number may have several parts: merged, and the customers first
    named = pairs.join(customers.hint("merge"), F.col("outer") == F.lower("c_name")).select("inner", "c_custkey")
    return named.join(parts.hint("merge"), F.col("inner") == F.col("number")).select("p_partkey", "c_custkey")


@_add("updated_in_place", "SELECT c_custkey, CASE WHEN c_custkey IN (11, 500) THEN 'new' ELSE c_name END AS c_name, c_nationkey FROM customer")
def _updated_in_place(spark: SparkSession, folder: str) -> DataFrame:
    path, rows = store.scratch(spark, "customers"), _table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    upkeep.stored(rows, path, ["c_custkey"], 16)
    changes = rows.filter("c_custkey IN (11, 500)").select("c_custkey", F.lit("new").alias("c_name"))
    upkeep.update_stored(spark, path, changes, ["c_custkey"], 16)
    return spark.read.parquet(path).select("c_custkey", "c_name", "c_nationkey")


_MEASURES = ["size", "symbols", "kinds"]


@_add("fitted_classifier", "SELECT count(*) AS n, true AS accurate, true AS ranked FROM documents JOIN labels USING (doc_id) WHERE doc_id % 5 = 0 AND quality IN (0, 1)")
def _fitted(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' quality from three measures of their texts and their language, fitted on four fifths of the labelled ones; of the rest,
    at least nine in ten must be right, and a good one must be ranked over a bad one nine times in ten."""
    words = F.split("text", "\\s+")
    path = store.scratch(spark, "measures")
    # measured before the join, so that no text travels
    measured = _table(spark, folder, "documents").select(
        "doc_id", "lang", F.log1p("n_chars").alias("size"),
        (F.length(F.regexp_replace("text", "[\\p{L}\\s]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("symbols"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("kinds"),
    )
    measured.join(_table(spark, folder, "labels").select("doc_id", "quality"), "doc_id").write.parquet(path)
    rows = spark.read.parquet(path)
    model = classify.fit(rows.filter("doc_id % 5 <> 0"), "quality", _MEASURES, ["lang"])
    told = classify.measured(classify.scored(rows.filter("doc_id % 5 = 0"), model, _MEASURES, ["lang"]), "quality")
    return told.select("n", (F.col("accuracy") >= 0.9).alias("accurate"), (F.col("auc") >= 0.9).alias("ranked"))


# search by indexes

_SEARCHED = "onion and the onereing"


@_add("search_indexed", search.search_sql(_SEARCHED, 20, "documents", "text", "doc_id"))
def _search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    index = search.build(_table(spark, folder, "documents"), store.scratch(spark, "words"), "text", "doc_id")
    return search.search(spark, index, _SEARCHED, 20).select(F.col("id").alias("doc_id"), F.round("score", 9).alias("score"))


@_add("vectors_indexed", """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS asked FROM embeddings WHERE vec_id < 8), s AS (SELECT query, vec_id, list_cosine_similarity(embedding::DOUBLE[], asked) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM s) SELECT query, vec_id, round(score, 6) AS score, place::INT AS place FROM r WHERE place <= 10""")
def _vectors_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector is indexed; the first eight are what is asked for."""
    rows = _table(spark, folder, "embeddings")
    index = vectors.build(rows, store.scratch(spark, "cells"), "embedding", "vec_id")
    asked = rows.filter("vec_id < 8").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return vectors.search(spark, index, asked, 10).select("query", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "place")
