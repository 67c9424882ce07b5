"""Each query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from kinloom import oracles, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(names, data):
    clean = lambda v: None if v is None else repr(round(float(v), 6)) if isinstance(v, float) and not math.isnan(v) else repr(v)
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(clean(r[i])) for i in at) for r in data)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_is_its_sql(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cur.fetchall())
