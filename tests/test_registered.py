"""Every registered analysis query against another engine, over the smallest driver tables."""

import os

import pytest

from ripplefront.plans import queries as q
from ripplefront.plans.encodings import TABLES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(q.ORACLE)


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, other, name):
    df = q.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = other.execute(q.ORACLE[name])
    at = [[d[0] for d in found.description].index(n) for n in names]
    want = sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == want


def test_flagship_has_rows(spark):
    assert q.flagship(spark, SF).count() > 0
