"""Every registered query against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    result, _ = check.compare(spark, duck, name, SF_DIR)
    assert result.startswith(("equal", "rows"))


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["l_returnflag"] for r in rows] and len(rows) == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
