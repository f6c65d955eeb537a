"""The driver's contract, and that the library stands without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as spark_entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_query_is_callable_and_sql_belongs_to_one():
    queries, sql = spark_entry.queries(), spark_entry.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables")
def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["name", "count"] and df.count() > 0


def test_without_the_training_data_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; print(len(e.queries()), len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[-2]) > 60


def test_nothing_else_imports_it():
    for path in (ROOT / "casewright").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "casewright.llm" not in path.read_text() and "from .llm" not in path.read_text()
