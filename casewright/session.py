"""Sessions with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, so that days and months don't move; ANSI, with quoted identifiers, so that case SQL written for PostgreSQL parses.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "casewright", **settings: str) -> SparkSession:
    """A session with SETTINGS and ``settings`` (dots written as two underscores); master and resources come from spark-submit."""
    conf = SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
