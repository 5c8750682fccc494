"""Registered queries of the subpackage against their SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from hushmark.llm.queries import ORACLE, QUERIES
from tools.compare import normal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(shipped, duck, name):
    df = QUERIES[name](shipped, SF)
    cur = duck.execute(ORACLE[name])
    assert normal(df.collect(), df.columns) == normal(cur.fetchall(), [d[0] for d in cur.description])
