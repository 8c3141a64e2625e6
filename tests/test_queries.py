"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from moltide.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame.astype(object).where(frame.notna(), None)
    plain = lambda v: round(float(v), 9) if v is not None and not isinstance(v, str | bool) and hasattr(v, "__float__") else v
    return sorted(str(tuple(map(plain, r))) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got[want.columns]) == rows(want)


def test_all_have_oracles():
    assert set(QUERIES) == set(ORACLES)
