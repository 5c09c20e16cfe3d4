"""Fingerprints at most one bit apart in a bucket over the limit."""

from meshwright.llm import simhash
from meshwright.llm.components import components


def test_hot_bucket(spark):
    fps = [5 << 40, 5 << 40 | 1, 5 << 40 | 3, 5 << 40 | 1 << 20 | 1 << 21]
    links = simhash.fingerprint_links(spark.createDataFrame([(k, f) for k, f in enumerate(fps)], "node long, fp long"), 1, 1)
    assert {r.node: r.root for r in components(links).collect()} == {0: 0, 1: 0, 2: 0}
