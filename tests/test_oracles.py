"""Every registered query of the engine against its SQL, on whole tables."""

import glob
import math
import os

import duckdb
import pytest

from eventloom.plans import long_queries, method_queries, more_queries, queries, result_queries

assert long_queries and more_queries and result_queries and method_queries
DATA = "/root/testdata/sf0.01"  # the size of the correctness gate


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = [tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in queries.ORACLES:
        assert len(got) > 0
        return
    ran = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in ran.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(cell(r[names.index(c)]) for c in sorted(names)) for r in ran.fetchall()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, (int, float)) for x in (*a, *b)) else a == b
