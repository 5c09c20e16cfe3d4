"""Sparse matrices as tables ``(row, col, val)`` and vectors as ``(idx, value)``.

Indices are native keys: joins replace dense renumbering, and a missing row is
a masked cell. Reciprocals of zero are null, never infinite.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def consolidate(m: DataFrame) -> DataFrame:
    """Entries of one place summed."""
    return m.groupBy("row", "col").agg(F.sum("val").alias("val"))


def sums(m: DataFrame, axis: str = "row", invert: bool = False) -> DataFrame:
    """``(idx, w)``: the sums over each row or column, or their reciprocals."""
    total = F.sum("val")
    return m.groupBy(F.col(axis).alias("idx")).agg((F.try_divide(F.lit(1.0), total) if invert else total).alias("w"))


def scale(m: DataFrame, w: DataFrame, axis: str = "row", invert: bool = False) -> DataFrame:
    """Each entry times, or divided by, the weight ``(idx, w)`` of its row or column; entries without a weight are dropped."""
    factor = F.try_divide(F.lit(1.0), F.col("w")) if invert else F.col("w")
    return m.join(w.select(F.col("idx").alias(axis), "w"), axis).select("row", "col", (F.col("val") * factor).alias("val"))


def multiply(left: DataFrame, right: DataFrame) -> DataFrame:
    """The matrix product: a join on the inner index and a sum by place."""
    r = right.select(F.col("row").alias("k"), F.col("col").alias("rcol"), F.col("val").alias("rval"))
    products = left.join(r, left["col"] == r["k"]).select("row", F.col("rcol").alias("col"), (F.col("val") * F.col("rval")).alias("val"))
    return consolidate(products)


def multiply_blocks(left: DataFrame, right: DataFrame, block: int = 1024) -> DataFrame:
    """The same product, for a left matrix whose nearby rows share columns, as those of a smoother do.

    An entry of the right matrix is dealt out once for each block of rows that needs
    it, with that block's factors, not once for each product. It can't be more than
    the products, and nothing is broadcast.
    """
    b = F.col("row") - F.pmod("row", F.lit(block))
    near = left.repartition("col").groupBy(b.alias("b"), F.col("col").alias("k")).agg(F.collect_list(F.struct("row", "val")).alias("to"))
    r = right.select(F.col("row").alias("k"), F.col("col").alias("rcol"), F.col("val").alias("rval"))
    met = near.join(r.hint("merge"), "k").select("b", "to", "rcol", "rval").repartition("b")
    products = met.select("b", F.explode("to").alias("t"), "rcol", "rval").select("b", F.col("t.row").alias("row"), F.col("rcol").alias("col"), (F.col("t.val") * F.col("rval")).alias("val"))
    return products.groupBy("b", "row", "col").agg(F.sum("val").alias("val")).drop("b")


def apply(m: DataFrame, vector: DataFrame, fill: float | None = None, n: int | None = None, skip_null: bool = True) -> DataFrame:
    """Matrix times vector, ``(idx, value)``.

    Rows without an entry are absent, or with ``n`` present as ``fill``. A null
    value is left out, or with ``skip_null=False`` makes its rows null.
    """
    v = vector.select(F.col("idx").alias("col"), "value")
    terms = m.join(v, "col")
    total = F.sum(F.col("val") * F.col("value"))
    if not skip_null:
        total = F.when(F.count("value") == F.count("*"), total)
    else:
        terms = terms.filter("value is not null")
    out = terms.groupBy(F.col("row").alias("idx")).agg(total.alias("value"))
    if n is None:
        return out
    every = m.sparkSession.range(n).withColumnRenamed("id", "idx").join(out.withColumn("hit", F.lit(True)), "idx", "left")
    return every.select("idx", F.when(F.col("hit"), F.col("value")).otherwise(F.lit(fill).cast("double")).alias("value"))


def crop(m: DataFrame, keep: DataFrame, axis: str = "row") -> DataFrame:
    """Entries whose row or column is in ``keep`` (``idx``)."""
    return m.join(keep.select(F.col("idx").alias(axis)).distinct(), axis, "left_semi").select("row", "col", "val")


def stack(top: DataFrame, bottom: DataFrame, row_offset: int = 0, col_offset: int = 0) -> DataFrame:
    """Both matrices' entries, the second one's keys moved by the offsets."""
    return top.union(bottom.select(F.col("row") + row_offset, F.col("col") + col_offset, "val"))


def densify(vectors: DataFrame, n: int, values: list[str], fill: float | None = None, factor: float = 1.0) -> DataFrame:
    """``(idx, weight, *values)`` with repeated indices to one row for each of ``n`` cells: sums of values over sums of weights."""
    sums_ = vectors.groupBy("idx").agg(F.sum("weight").alias("weight"), *(F.sum(v).alias(v) for v in values))
    every = vectors.sparkSession.range(n).withColumnRenamed("id", "idx").join(sums_, "idx", "left")
    return every.select("idx", *(F.coalesce(F.try_divide(F.col(v) * factor, F.col("weight")), F.lit(fill).cast("double")).alias(v) for v in values))


def concatenate(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Multivectors one below the other; all must have the same variables."""
    for other in rest:
        if set(other.columns) != set(first.columns):
            raise ValueError(f"variables differ: {sorted(first.columns)} and {sorted(other.columns)}")
        first = first.unionByName(other)
    return first


@dataclass
class WeightedMatrix:
    """A matrix with the weights of its rows and columns, ``(idx, w)`` each."""

    M: DataFrame
    wM: DataFrame
    Mw: DataFrame
    conservative: bool = True
    scaled: bool = True

    def apply(self, vector: DataFrame, fill: float | None = None, n: int | None = None, force_conservation: bool = False) -> DataFrame:
        """The regridded vector; unscaled matrices are scaled by their row weights. Forced conservation multiplies by one common factor."""
        m = self.M if self.scaled else scale(self.M, self.wM, "row", invert=True)
        out = apply(m, vector)
        if force_conservation and not self.conservative:
            whole = self.Mw.join(vector, "idx").agg(F.sum(F.col("w") * F.col("value")).alias("x"))
            got = self.wM.join(out, "idx").agg(F.sum(F.col("w") * F.col("value")).alias("y"))
            out = out.join(F.broadcast(whole.crossJoin(got))).select("idx", (F.col("value") * F.try_divide(F.col("x"), F.col("y"))).alias("value"))
        if n is None:
            return out
        every = out.sparkSession.range(n).withColumnRenamed("id", "idx").join(out, "idx", "left")
        return every.select("idx", F.coalesce("value", F.lit(fill).cast("double")).alias("value"))

    def integral(self, vector: DataFrame, side: str = "row") -> DataFrame:
        """``(total)``: values times weights."""
        w = self.wM if side == "row" else self.Mw
        return w.join(vector, "idx").agg(F.sum(F.col("w") * F.col("value")).alias("total"))
