"""Every registered query against the same question in SQL, over whole tables of the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import TESTDATA
from winfleet.plans.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", f"{TESTDATA}/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return value if isinstance(value, (str, bool)) else format(float(value), ".12g")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    wanted = sql.execute(entry.oracle_sql()[name]).fetch_df()
    assert len(wanted) > 0
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)

    def rows(frame):
        return sorted((tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)), key=repr)

    assert rows(got) == rows(wanted)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["location_id", "window_start", "temperature"]


CHECKS = {
    "sf0.001": {"prefix_join_all": 133, "orphan_jobs": 1430, "latest_state": 3, "idle_workers": 2},
    "sf0.01": {"prefix_join_all": 11970, "orphan_jobs": 8700, "latest_state": 92, "idle_workers": 18, "sliding_avg_temperature": 114755},
}


@pytest.mark.parametrize("scale", CHECKS)
def test_known_row_counts(spark, scale):
    for name, expected in CHECKS[scale].items():
        assert entry.queries()[name](spark, f"{TESTDATA}/{scale}").count() == expected
