import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from lexgrove.plans import catalogue

SMALL = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def oracle():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{name}')")
    return c


def canonical(frame):
    return sorted(tuple(str(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_equals_its_sql(spark, oracle, name):
    got, want = catalogue.queries()[name](spark, SMALL).toPandas(), oracle.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id"]


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "rest", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1') or n == 'pipeline' for n in q)); e.oracle_sql()"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "rest", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(catalogue.queries())), "False"]
