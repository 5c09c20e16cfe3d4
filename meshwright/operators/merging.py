"""Joining elevation-class data sets: squashing equal classes, stacking local on global, adding up chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import coo


def squash_classes(m: DataFrame, hcdefs: DataFrame, n_a: int, axis: str = "row") -> tuple[DataFrame, DataFrame]:
    """Give classes of equal elevation one number, in ascending order, and sum their entries.

    ``hcdefs (ihc, elev, underice)``; keys along ``axis`` are ``ihc * n_a + a``. Returns
    the matrix and the new ``hcdefs``; a class keeps the least of its codes.
    """
    numbered = hcdefs.withColumn("new", F.dense_rank().over(Window.orderBy("elev")) - 1)
    new = numbered.groupBy(F.col("new").alias("ihc")).agg(F.first("elev").alias("elev"), F.min("underice").alias("underice"))
    old = F.floor((F.col(axis) - F.pmod(F.col(axis), F.lit(n_a))) / n_a).cast("int")
    x = m.withColumn("ihc", old).join(F.broadcast(numbered.select("ihc", "new")), "ihc")
    x = x.withColumn(axis, F.col("new").cast("long") * n_a + F.pmod(F.col(axis), F.lit(n_a)))
    return coo.consolidate(x.select("row", "col", "val")), new


def stack_classes(local: DataFrame, everywhere: DataFrame, n_local: int, n_a: int, axis: str = "row") -> DataFrame:
    """Local class matrices below global ones: the latter's keys move up by ``n_local`` classes."""
    return coo.stack(local, everywhere, **{f"{axis}_offset": n_local * n_a})


def combine_chunks(chunks: DataFrame, weights: DataFrame, scale: bool = False) -> tuple[DataFrame, DataFrame]:
    """Matrices ``(chunk, row, col, val)`` and row weights ``(chunk, idx, w)`` of all chunks, added up; optionally scaled by the sums."""
    w = weights.groupBy("idx").agg(F.sum("w").alias("w"))
    m = coo.consolidate(chunks.select("row", "col", "val"))
    return (coo.scale(m, w, "row", invert=True) if scale else m), w


def plan_chunks(cells: DataFrame, limit: int) -> DataFrame:
    """``(idx, n)`` in the order of idx with ``chunk``: a chunk ends with the cell that brings it to ``limit``.

    Every cell goes to chunk ``floor((n before it) / limit)``. Blocks of idx are summed
    first, so no task sees more than a block's cells or one sum a block.
    """
    size = 1 << 16
    block = F.expr(f"idx div {size}")
    sums = cells.groupBy(block.alias("block")).agg(F.sum("n").alias("bn"))
    ahead = F.coalesce(F.sum("bn").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = cells.withColumn("block", block).withColumn("inside", inside).join(sums.withColumn("ahead", ahead).drop("bn"), "block")
    return x.select("idx", "n", F.floor((F.col("ahead") + F.col("inside")) / limit).cast("long").alias("chunk"))


def class_range(elev: DataFrame, step: float = 200.0) -> DataFrame:
    """``(lo, hi, n)``: the elevations rounded outward to whole steps, and the number of points between them."""
    r = elev.agg(F.min("elev").alias("lo"), F.max("elev").alias("hi"))
    r = r.select((F.floor(F.col("lo") / step) * step).cast("double").alias("lo"), (F.ceil(F.col("hi") / step) * step).cast("double").alias("hi"))
    return r.withColumn("n", ((F.col("hi") - F.col("lo")) / step).cast("long") + 1)


def check_local(m: DataFrame, n_a: int, row_class: bool = False, col_class: bool = True) -> DataFrame:
    """Entries of an A/E matrix that join different A cells."""
    a = lambda axis, cls: F.pmod(F.col(axis), F.lit(n_a)) if cls else F.col(axis)
    return m.filter(a("row", row_class) != a("col", col_class))
