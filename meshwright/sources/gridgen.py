"""Grid generators: cells with polygon rings from arithmetic over ``spark.range``, no vertex objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.grids import LonLatSpec, XYSpec
from .tables import shared_path


def _edges(values: tuple[float, ...]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _vertex(x: Column, y: Column) -> Column:
    return F.struct(F.lit(None).cast("long").alias("vid"), x.alias("x"), y.alias("y"))


def xy_cells(spark: SparkSession, spec: XYSpec, clip: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(cell_id, i, j, native_area, cx, cy, ring)``, cell_id = j * nx + i; ``clip`` gets the ring."""
    rows = spark.range(spec.nx * spec.ny).withColumnRenamed("id", "cell_id")
    rows = rows.withColumns({"i": F.pmod("cell_id", F.lit(spec.nx)).cast("int"), "j": F.expr(f"cast(cell_id div {spec.nx} as int)")})
    xb, yb = _edges(spec.xb), _edges(spec.yb)
    x0, x1, y0, y1 = F.get(xb, F.col("i")), F.get(xb, F.col("i") + 1), F.get(yb, F.col("j")), F.get(yb, F.col("j") + 1)
    rows = rows.withColumn("ring", F.array(_vertex(x0, y0), _vertex(x1, y0), _vertex(x1, y1), _vertex(x0, y1)))
    if clip is not None:
        rows = rows.filter(clip(F.col("ring")))
    cx, cy = geometry.centroid(F.col("ring"))
    return rows.select("cell_id", "i", "j", geometry.shoelace(F.col("ring")).alias("native_area"), cx.alias("cx"), cy.alias("cy"), "ring")


def lonlat_cells(spark: SparkSession, spec: LonLatSpec, clip: Callable[..., Column] = geometry.keep_all, rings: bool = True) -> DataFrame:
    """``(cell_id, i, j, native_area, cx, cy[, ring])`` in degrees, cell_id = j * nlon + i.

    East-west edges have ``points_in_side`` segments. A polar cap is one cell at
    i = 0 of its row, whose ring runs along its parallel. ``clip`` gets lon0, lat0,
    lon1, lat1. Areas are exact on the sphere.
    """
    n = spec.nlon
    south = int(spec.south_pole)
    lonb, latb = _edges(spec.lonb), _edges(spec.latb)
    rows = spark.range(spec.nlon * spec.nlat).withColumnRenamed("id", "cell_id")
    rows = rows.withColumns({"i": F.pmod("cell_id", F.lit(n)).cast("int"), "j": F.expr(f"cast(cell_id div {n} as int)")})
    is_south = (F.col("j") == 0) & F.lit(spec.south_pole)
    is_north = (F.col("j") == spec.nlat - 1) & F.lit(spec.north_pole)
    cap = is_south | is_north
    rows = rows.withColumn("cap", cap).filter(~F.col("cap") | (F.col("i") == 0))
    lat0 = F.when(is_south, -90.0).otherwise(F.get(latb, F.col("j") - south))
    lat1 = F.when(is_north, 90.0).otherwise(F.get(latb, F.col("j") - south + 1))
    lon0, lon1 = F.get(lonb, F.col("i")), F.when(F.col("cap"), F.lit(spec.lonb[0] + 360.0)).otherwise(F.get(lonb, F.col("i") + 1))
    rows = rows.withColumns({"lon0": lon0, "lon1": lon1, "lat0": lat0, "lat1": lat1})
    rows = rows.filter(clip(F.col("lon0"), F.col("lat0"), F.col("lon1"), F.col("lat1")))
    colat = F.when(F.col("lat1") == 90, 90 - F.col("lat0")).otherwise(F.col("lat1") + 90)
    area = F.when(F.col("cap"), geometry.polar_cap_area(colat, spec.eq_rad)).otherwise(geometry.graticule_area(F.col("lon0"), F.col("lat0"), F.col("lon1"), F.col("lat1"), spec.eq_rad))
    out = rows.withColumns({"native_area": area, "cx": F.when(F.col("cap"), 0.0).otherwise((F.col("lon0") + F.col("lon1")) / 2), "cy": F.when(is_south, -90.0).when(is_north, 90.0).otherwise((F.col("lat0") + F.col("lat1")) / 2)})
    names = ["cell_id", "i", "j", "native_area", "cx", "cy"]
    if not rings:
        return out.select(*names)
    p = spec.points_in_side
    side = lambda a, b, y: F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda k: _vertex(a + (b - a) * k / p, y))
    box = F.concat(side(F.col("lon0"), F.col("lon1"), F.col("lat0")), side(F.col("lon1"), F.col("lon0"), F.col("lat1"))) if p > 1 else F.array(_vertex(F.col("lon0"), F.col("lat0")), _vertex(F.col("lon1"), F.col("lat0")), _vertex(F.col("lon1"), F.col("lat1")), _vertex(F.col("lon0"), F.col("lat1")))
    if p > 1:
        box = F.concat(side(F.col("lon0"), F.col("lon1"), F.col("lat0")), F.array(_vertex(F.col("lon1"), F.col("lat0"))), side(F.col("lon1"), F.col("lon0"), F.col("lat1")), F.array(_vertex(F.col("lon0"), F.col("lat1"))))
    around = F.slice(lonb, 1, n)
    rim_s = F.transform(around, lambda x: _vertex(x, F.col("lat1")))
    rim_n = F.transform(around, lambda x: _vertex(x, F.col("lat0")))
    ring = F.when(is_south, rim_s).when(is_north, F.reverse(rim_n)).otherwise(box)
    return out.select(*names, ring.alias("ring"))


def cells_of(cells: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The kept cells and ``(vid, x, y)`` of the vertices that they use; the full size of the grid is not changed by it."""
    kept = cells.filter(keep)
    used = kept.select(F.explode("ring").alias("v")).select("v.*").distinct()
    return kept, used


def number_vertices(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rings with vertex numbers in the order of (x, y), equal points being one vertex; and ``(vid, x, y)``.

    Points are sorted over range partitions and stored; the rows of partitions before
    are counted first, so no task sees all vertices, however they lie.
    """
    order = ("x", "y")
    pts = cells.select(F.explode("ring").alias("v")).select("v.x", "v.y").distinct()
    path = shared_path(cells.sparkSession, "vertices")
    pts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    pts = cells.sparkSession.read.parquet(path)
    sums = pts.groupBy("part").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    numbered = pts.withColumn("k", inside).join(sums.withColumn("ahead", ahead).drop("n"), "part").select((F.col("ahead") + F.col("k")).cast("long").alias("vid"), "x", "y")
    flat = cells.select("cell_id", F.posexplode("ring").alias("pos", "v")).select("cell_id", "pos", "v.x", "v.y").join(numbered, ["x", "y"])
    rings = flat.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("pos", "vid", "x", "y"))).alias("r"))
    rings = rings.select("cell_id", F.transform("r", lambda p: F.struct(p["vid"].alias("vid"), p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return cells.drop("ring").join(rings, "cell_id"), numbered
