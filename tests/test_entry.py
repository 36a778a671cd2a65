"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from drumlin.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Minutes of jobs for a result that unit tests hold against brute force.
SLOW = {"mst_boruvka"}


def norm(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    r = con.execute(ORACLES[name])
    columns, data = [d[0] for d in r.description], r.fetchall()
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: [(x is None, str(x)) for x in row]
    got = sorted((tuple(norm(row[c]) for c in columns) for row in df.collect()), key=key)
    assert got == sorted((tuple(map(norm, row)) for row in data), key=key)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["point_id", "label"] and df.count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())
