"""Meshes with values at vertices, linear within each triangle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from . import coo


def basis_matrix(pieces: DataFrame, elements: DataFrame) -> DataFrame:
    """``(row, col, val)`` from vertices to A cells: integrals of the vertices' basis functions.

    ``pieces (a_id, i_id, ring)``: the part of each element in each A cell;
    ``elements (i_id, ring)``: triangles with numbered vertices. A basis function is 1
    at its vertex, 0 at the others and linear between.
    """
    x = pieces.join(elements.select("i_id", F.col("ring").alias("tri")), "i_id")
    x = x.select("a_id", "ring", "tri", F.posexplode("tri").alias("k", "v"))
    at = lambda d: F.element_at("tri", (F.pmod(F.col("k") + d, F.lit(3)) + 1).cast("int"))
    p = [at(0), at(1), at(2)]
    a, b, c = geometry.plane_through([v["x"] for v in p], [v["y"] for v in p], [F.lit(1.0), F.lit(0.0), F.lit(0.0)])
    x = x.select(F.col("a_id").alias("row"), F.col("v.vid").alias("col"), geometry.plane_integral(F.col("ring"), a, b, c).alias("val"))
    return x.groupBy("row", "col").agg(F.sum("val").alias("val"))


def weighted_basis(pieces: DataFrame, elements: DataFrame, scale: bool = False) -> coo.WeightedMatrix:
    """``basis_matrix`` with its weights: the area of each A cell, and of what each vertex stands for."""
    m = basis_matrix(pieces, elements)
    wm, mw = coo.sums(m, "row"), coo.sums(m, "col")
    return coo.WeightedMatrix(coo.scale(m, wm, "row", invert=True) if scale else m, wm, mw, True, scale)
