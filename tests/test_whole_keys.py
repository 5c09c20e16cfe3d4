"""Queries at a scale where their SQL, written for fewer keys, no longer holds all: every key must still have its row."""

import os

import pytest

from meshwright.plans import queries as own
from meshwright.plans import queries_products

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_atmosphere_weights(spark):
    keys = {r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    got = {r.idx: r.w for r in own.queries()["atmosphere_weights"](spark, SF).collect()}
    assert keys < set(got)
    assert all(w == (101.0 + k % 5 if k in keys else -1.0) for k, w in got.items())


def test_coo_apply_fill(spark):
    keys = {r.l_suppkey for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().collect()}
    got = {r.idx: r.value for r in own.queries()["coo_apply_fill"](spark, SF).collect()}
    assert keys < set(got) and max(got) > max(keys)
    assert all(got[k] > 0 for k in keys) and all(got[k] == -1.0 for k in set(got) - keys)


def test_folded_parts(spark):
    cells = {}
    for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_retailprice").collect():
        cells.setdefault(r.p_partkey % 2048, []).append(r.p_retailprice)
    got = {r.idx: r.zicetop for r in queries_products._raw(spark, SF).collect()}
    assert len(got) == 2048
    assert all(abs(got[k] - sum(v) / len(v) * 0.999983217 - k % 13) < 1e-6 for k, v in cells.items())
