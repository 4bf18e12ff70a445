"""The driver's contract: every query with SQL against DuckDB, and the rest without the training-data operators."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def core():
    from potluck.plans import queries

    return queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(core()[1]))
def test_query_matches_sql(spark, duck, name):
    made = core()[0][name](spark, DATA)
    asked = duck.sql(core()[1][name])
    assert sorted(made.columns) == sorted(asked.columns)
    order = [asked.columns.index(c) for c in made.columns]
    assert sorted(repr(tuple(r)) for r in made.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in asked.fetchall())


@pytest.mark.parametrize("name", sorted(set(core()[0]) - set(core()[1])))
def test_query_without_sql_has_rows(spark, name):
    assert core()[0][name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)}, timeout=120)


def test_nothing_outside_imports_the_training_data_operators():
    for p in ROOT.glob("potluck/**/*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text(encoding="utf-8")), p
