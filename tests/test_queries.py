"""Every registered query against its SQL, at a small scale."""

import glob
import os

import duckdb
import pytest

from permaway.plans import ORACLES, QUERIES
from tests.conftest import DATA
from tools.check_queries import rows_of, same


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def check(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    found = db.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    a_cols, a = rows_of(df.columns, got)
    b_cols, b = rows_of(columns, found.fetchall())
    assert a_cols == b_cols
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(same(p, q, True) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    check(spark, db, name)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
