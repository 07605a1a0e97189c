"""Every catalog query against its SQL equivalent on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    text, ok = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert ok, text


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
