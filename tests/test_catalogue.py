"""Each query of the catalogue against the same question in DuckDB, on the smallest tables."""

import os

import pytest

from weftline.plans import artifacts, catalogue, given, history, inventory, rows  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(rows, columns, names):
    at = [columns.index(n) for n in names]
    show = lambda v: None if v is None else round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(str(tuple(show(r[k]) for k in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in frame.collect()]
    if name not in catalogue.ORACLES:
        assert len(set(frame.columns)) == len(frame.columns)
        return
    want = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(frame.columns)
    assert plain(rows, frame.columns, sorted(columns)) == plain(want.fetchall(), columns, sorted(columns))


def test_entry_works_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/weftline", tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
