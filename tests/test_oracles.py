"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from meshwright.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(own.queries()) == set(own.oracle_sql())


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_matches_sql(spark, duck, name):
    df = own.queries()[name](spark, SF)
    rel = duck.sql(own.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    want = sorted(repr(tuple(r[rel.columns.index(c)] for c in cols)) for r in rel.fetchall())
    assert got == want
