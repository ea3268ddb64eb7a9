"""Every catalogue query against its SQL, on the smallest tables."""

import decimal
import glob

import duckdb
import pytest

from bytequarry.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {p.split('/')[-1][:-8]} as select * from '{p}'")
    return con


def norm(v):
    return int(v) if isinstance(v, decimal.Decimal) and v == int(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, db, name):
    got = QUERIES[name](spark, DIR)
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = sorted((tuple(norm(v) for v in r) for r in got.select(*want.columns).collect()), key=key)
    assert rows == sorted((tuple(norm(v) for v in r) for r in want.fetchall()), key=key)
