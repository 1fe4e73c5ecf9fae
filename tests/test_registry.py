"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessella.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def rows(cols, values):
    tidy = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == math.floor(v) else v
    return sorted(repr([tidy(r[cols.index(c)]) for c in sorted(cols)]) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    out = QUERIES[name](spark, DATA)
    got = rows(out.columns, [tuple(r) for r in out.collect()])
    assert got
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name])
        assert sorted(out.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())
