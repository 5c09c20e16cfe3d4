"""Connected components by alternating large-star and small-star steps over an edge table.

A table of at most SMALL edges, which are counted first, is solved by one task in
16 bytes an edge; a larger one, or what its steps leave of it, by the steps alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, scratch, table

SMALL = 1 << 20


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """For each u: link its neighbours to the least of them and u. Both join sides are stored, so AQE can split a hot u."""
    least = scratch(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least")
    return pairs.join(least, "u"), least


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges to each node's root, by hooking and jumping."""
    parts = [tuple(np.asarray(b.column(k)) for k in range(2)) for b in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in parts)]) for k in range(2))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, old[a], low)
        np.minimum.at(root, old[b], low)
        root = root[root]
        if np.array_equal(root, old):
            break
    for k in range(0, len(nodes), 1 << 16):
        yield table("node:long root:long", nodes[k : k + (1 << 16)], nodes[root[k : k + (1 << 16)]])


def components(edges: DataFrame, max_rounds: int = 60, at_once: int = SMALL) -> DataFrame:
    """``(u long, v long)`` edges to ``(node, root)``, root being the smallest node reachable.

    Only nodes with an edge to another node come back. Null ends, loops and
    repeated edges are ignored; no edges give an empty table. Each round costs
    shuffles of the edges only, a node's neighbours are never gathered.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    now = scratch(edges.dropna().filter("u <> v").select(u.alias("u"), v.alias("v")).distinct(), "edges")
    before = _digest(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        if before[0] <= at_once:
            solved = scratch(now.coalesce(1).transform(arrow_map, _solve, "node long, root long"), "solved")
            discard(now)
            return solved
        both = now.union(now.select("v", "u"))
        large, least = _star(both, "large")
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch(large.filter("u <> v").distinct(), "large")
        small, less = _star(large, "small")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        old, now = now, scratch(small.filter("u <> v").distinct(), "edges")
        discard(old, least, large, less)
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
