"""The questions a front end can ask, by name. Each answers with a status and, if all went well, a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import SparkSession

from casewright.operators import cases, insights, network, profile, retrieval, risk
from casewright.plans import sqlgate, viz
from casewright.sources.tables import Tables

LLM_ROWS, SUMMARY_ROWS, TABLE_ROWS, GRAPH_ROWS = 40, 15, 100, 80


@dataclass
class Context:
    spark: SparkSession
    tables: Tables
    as_of: datetime


def query(c: Context, sql: str) -> dict[str, Any]:
    """Run a reading statement over the tables."""
    cleaned = sqlgate.without_ungrouped_id(sqlgate.sanitize(sql))
    c.tables.register()
    return {"rows": sqlgate.run(c.spark, cleaned), "sql": cleaned, "viz": viz.classify(cleaned)}


def related_cases(c: Context, text: str, k: int = 5) -> dict[str, Any]:
    rows = cases.attach(c.tables, c.tables["CaseMaster"], "head", "unit", "district", how="left").select("CaseMasterID", "CrimeNo", "BriefFacts", "CrimeGroupName", "DistrictName")
    return {"rows": retrieval.by_words(rows, text, k, "BriefFacts", "CaseMasterID")}


def check_insights(c: Context) -> dict[str, Any]:
    return {"rows": insights.insights(c.tables, c.as_of)}


def network_or_map(c: Context, kind: str) -> dict[str, Any]:
    if kind == "map":
        return {"rows": cases.district_counts(c.tables)}
    if kind == "network":
        edges = network.edges(c.tables)
        return {"rows": edges, "nodes": network.nodes(c.tables, edges)}
    raise ValueError("kind is network or map")


def predict_risk(c: Context, has_arrest: bool, days: float, heinous: bool, victim_count: int, accused_count: int) -> dict[str, Any]:
    row = c.spark.createDataFrame([(has_arrest, float(days), heinous, victim_count, accused_count)], "has_arrest boolean, days double, heinous boolean, victim_count int, accused_count int")
    return {"rows": risk.with_risk(row)}


def profiles(c: Context, which: str) -> dict[str, Any]:
    return {"rows": profile.profile(c.tables, which)}


TOOLS: dict[str, Callable[..., dict[str, Any]]] = {"queryDatabase": query, "searchRelatedCases": related_cases, "checkInsights": check_insights, "getNetworkOrMapData": network_or_map, "predictRisk": predict_risk, "getProfile": profiles}


def call(c: Context, name: str, **arguments: Any) -> dict[str, Any]:
    """{status: ok, ...} or {status: error, message}; never raises for what a caller asks."""
    try:
        return {"status": "ok", **TOOLS[name](c, **arguments)}
    except Exception as e:
        return {"status": "error", "message": f"{type(e).__name__}: {e}"[:500]}


def capped(rows, n: int = LLM_ROWS) -> tuple[list[dict], int | None]:
    """At most ``n`` rows for a summary, and, if there are more, how many there are."""
    found = [r.asDict(recursive=True) for r in rows.take(n + 1)]
    return found[:n], rows.count() if len(found) > n else None
