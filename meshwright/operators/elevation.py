"""Elevation masks and elevation classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mask codes of ice model output.
BEDROCK, GROUNDED, FLOATING, OCEAN, UNKNOWN = 0, 2, 3, 4, -1


def mask_to_elevation(mask: Column, topg: Column, thk: Column) -> tuple[Column, Column]:
    """(land, ice): surface elevations; null where there is no land, or no ice."""
    surface = topg + thk
    iced = mask.isin(GROUNDED, FLOATING)
    return F.when(iced, surface).when(mask == BEDROCK, topg), F.when(iced, surface)


def elevmasks(raster: DataFrame, time: int | None = None) -> DataFrame:
    """``(kind, i_id, elev)`` from ``(time, i_id, mask, topg, thk)`` at one time, the last by default; masked cells are absent."""
    if time is None:
        raster = raster.join(F.broadcast(raster.agg(F.max("time").alias("time"))), "time")
    else:
        raster = raster.filter(F.col("time") == time)
    land, ice = mask_to_elevation(F.col("mask"), F.col("topg"), F.col("thk"))
    both = F.explode(F.array(F.struct(F.lit("land").alias("kind"), land.alias("elev")), F.struct(F.lit("ice").alias("kind"), ice.alias("elev"))))
    return raster.select("i_id", both.alias("x")).select("x.kind", "i_id", "x.elev").filter("elev is not null and not isnan(elev)")


def _points(hcdefs: list[float]) -> Column:
    if sorted(hcdefs) != list(hcdefs) or len(set(hcdefs)) != len(hcdefs) or not hcdefs:
        raise ValueError("height points must ascend")
    return F.array(*(F.lit(float(h)) for h in hcdefs))


def _above(z: Column, points: Column) -> Column:
    """How many height points lie below z: the index of the first that does not."""
    return F.size(F.filter(points, lambda h: h < z))


def bracket(df: DataFrame, hcdefs: list[float], z: str = "elev", clamp_top: bool = False) -> DataFrame:
    """``df`` with ``ihc, w``: two rows for each, one for each neighbouring height point, without those of weight zero.

    Below the lowest point the weights extrapolate. Above the highest they do too
    with ``clamp_top``; otherwise such an elevation raises.
    """
    points = _points(hcdefs)
    n = len(hcdefs)
    if n < 2:
        raise ValueError("interpolation needs two height points")
    up = _above(F.col(z), points)
    if not clamp_top:
        up = F.when(up >= n, F.raise_error(F.concat(F.lit("elevation above the highest height point: "), F.col(z).cast("string"))).cast("int")).otherwise(up)
    df = df.withColumn("_hi", F.least(F.greatest(up, F.lit(1)), F.lit(n - 1)))
    lo, hi = F.get(points, F.col("_hi") - 1), F.get(points, F.col("_hi"))
    ratio = (F.col(z) - lo) / (hi - lo)
    df = df.withColumn("_w", F.explode(F.array(F.struct((F.col("_hi") - 1).alias("ihc"), (1 - ratio).alias("w")), F.struct(F.col("_hi").alias("ihc"), ratio.alias("w")))))
    return df.select(*(c for c in df.columns if not c.startswith("_")), "_w.ihc", "_w.w").filter("w <> 0")


def nearest(df: DataFrame, hcdefs: list[float], z: str = "elev") -> DataFrame:
    """``df`` with ``ihc``, the nearest height point, the lower one of two, and ``w`` of 1."""
    points = _points(hcdefs)
    n = len(hcdefs)
    up = _above(F.col(z), points)
    lo, hi = F.get(points, F.greatest(up - 1, F.lit(0))), F.get(points, F.least(up, F.lit(n - 1)))
    near = F.when(up <= 0, 0).when(up >= n, n - 1).when(F.abs(F.col(z) - lo) <= F.abs(hi - F.col(z)), up - 1).otherwise(up)
    return df.select("*", near.cast("int").alias("ihc"), F.lit(1.0).alias("w"))
