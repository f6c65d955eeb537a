"""Every query over the star-schema tables against its SQL in DuckDB."""

import math
import os
from datetime import datetime

import duckdb
import pytest

from casewright.plans import items, star

QUERIES, SQL = star.QUERIES | items.QUERIES, star.SQL | items.SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value.isoformat() if isinstance(value, datetime) else value


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for table in TABLES:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    found = db.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert ours == sorted([tuple(plain(r[k]) for k in places) for r in found.fetchall()], key=repr)
