"""Registered queries against the oracle SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from hushmark.registry import QUERIES
from oracle.queries import ORACLE
from tools.compare import normal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    want, want_cols = normal(cur.fetchall(), [d[0] for d in cur.description])
    got, got_cols = normal(df.collect(), df.columns)
    assert got_cols == want_cols
    assert got == want
