"""Ocean grid to atmosphere grid, with fractional and rounded ocean masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import HntrSpec
from . import coo
from .overlap_ll import overlap_matrix


def ocean_scale(focean: DataFrame, invert: bool = False) -> DataFrame:
    """``(idx, w)`` between the masked and the fractional ocean grid: 1 / (1 - focean_p) where focean_m is 0.

    ``focean (idx, focean_p, focean_m)``; a masked value other than 0 or 1 raises,
    cells without any continent are absent.
    """
    m = F.when(F.col("focean_m").isin(0.0, 1.0), F.col("focean_m")).otherwise(F.raise_error(F.lit("focean_m must be 0 or 1")).cast("double"))
    cont = 1 - F.col("focean_p")
    rows = focean.withColumn("m", m).filter((F.col("m") == 0) & (cont != 0))
    return rows.select("idx", (cont if invert else F.try_divide(F.lit(1.0), cont)).alias("w"))


def continent_weights(focean: DataFrame, areas: DataFrame) -> DataFrame:
    """``(idx, w)``: the area of the cells that the masked grid has as continent."""
    return areas.join(ocean_scale(focean).select("idx"), "idx", "left_semi").select("idx", "w")


def continents(m: DataFrame, focean: DataFrame, axis: str = "col") -> DataFrame:
    """The entries of a matrix in cells that are continent in the masked grid."""
    return coo.crop(m, focean.filter("focean_m = 0").select("idx"), axis)


def class_pairs(spark: SparkSession, ocean: HntrSpec, atmosphere: HntrSpec, w_eo: DataFrame) -> DataFrame:
    """``(row, col, val)`` from ocean classes to atmosphere classes: each ocean cell's class weight, in the atmosphere cell that holds the ocean cell.

    ``w_eo (idx, w)`` has keys ``ihc * n_ocean + o``; the atmosphere's are ``ihc * n_atmosphere + a``.
    """
    pairs = overlap_matrix(spark, atmosphere, ocean, scaled=True).select(F.col("row").alias("a"), F.col("col").alias("o"))
    keyed = w_eo.select("idx", "w", F.pmod("idx", F.lit(ocean.size)).alias("o"))
    ihc = F.floor((F.col("idx") - F.col("o")) / ocean.size).cast("long")
    return keyed.join(pairs, "o").select(F.col("idx").alias("row"), (ihc * atmosphere.size + F.col("a")).alias("col"), F.col("w").alias("val"))


def atmosphere_from_ocean_classes(e_o_v_o: DataFrame, focean: DataFrame, ocean: HntrSpec, atmosphere: HntrSpec, areas: DataFrame) -> DataFrame:
    """The matrix A <- E on the atmosphere grid, from E <- O on the fractional ocean grid; rows sum to 1.

    Classes of an atmosphere cell get the area of the ocean cells' classes in it
    that are continent in the masked grid.
    """
    spark = e_o_v_o.sparkSession
    on = continents(e_o_v_o, focean, "col")
    corrected = coo.scale(on, ocean_scale(focean), "col")
    share = coo.scale(corrected, coo.sums(corrected, "col"), "col", invert=True)  # of each ocean cell, by class
    area = coo.scale(share, areas, "col")
    pairs = overlap_matrix(spark, atmosphere, ocean, scaled=True).select(F.col("row").alias("a"), F.col("col").alias("o"))
    ihc = F.floor((F.col("row") - F.pmod("row", F.lit(ocean.size))) / ocean.size).cast("long")
    big = area.join(pairs, F.col("col") == F.col("o")).select(F.col("a").alias("row"), (ihc * atmosphere.size + F.col("a")).alias("col"), "val")
    big = coo.consolidate(big)
    return coo.scale(big, coo.sums(big, "row"), "row", invert=True)
