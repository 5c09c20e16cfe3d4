"""Topography products: global ice mask, ocean-grid topography, atmosphere-grid topography."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grids import HntrSpec
from ..operators import topo
from ..operators.overlap_ll import nested_parent, overlap_matrix, regrid, regrid_many


def _row(idx: Column, g: HntrSpec) -> Column:
    return F.floor(idx / g.im).cast("int")


def cell_area(idx: Column, g: HntrSpec) -> Column:
    """Area of a cell of a regular grid on the unit sphere."""
    d, j = math.pi / g.jm, _row(idx, g)
    return (F.sin((j + 1 - g.jm / 2) * d) - F.sin((j - g.jm / 2) * d)) * (2 * math.pi / g.im)


def global_ice_mask(fine: DataFrame, snow: DataFrame, g: HntrSpec, coarse: HntrSpec, least_thickness: float = 50.0, north: float = 78.0) -> DataFrame:
    """``(idx, fgice)`` of a fine raster ``(idx, focean, thickness, elev, greenland)``.

    Ice is where the thickness reaches ``least_thickness``, and on all land north of
    ``north``. On the other northern land, outside Greenland, the coarse ice
    fractions ``snow (block, fraction)`` are filled in from the highest cells down.
    """
    lat = (_row(F.col("idx"), g) + 0.5 - g.jm / 2) * (g.dlat / 60)
    land = F.col("focean") == 0
    x = fine.withColumns({"lat": lat, "iced": land & ((F.col("thickness") >= least_thickness) | (lat > north)), "block": nested_parent(F.col("idx"), g, coarse), "area": cell_area(F.col("idx"), g)})
    free = x.filter(land & (F.col("lat") > 0) & ~F.col("greenland"))
    budget = snow.select("block", (F.col("fraction") * cell_area(F.col("block"), coarse)).alias("budget"))
    cells = free.select("idx", "block", _row(F.col("idx"), g).alias("j"), F.pmod("idx", F.lit(g.im)).cast("int").alias("i"), "elev", "area")
    filled = topo.budget_fill(cells, budget).filter("filled").select("idx", F.lit(True).alias("snow"))
    return x.join(filled, "idx", "left").select("idx", (F.col("iced") | F.coalesce("snow", F.lit(False))).cast("double").alias("fgice"))


def half_degree(fgice: DataFrame, g: HntrSpec, half: HntrSpec) -> DataFrame:
    """``(idx, value)``: a fine raster's plain means, the poles as one value each."""
    return regrid(fgice.select("idx", F.col("fgice").alias("value"), F.lit(1.0).alias("weight")), half, g, mean_polar=True)


# Where lakes are not kept. Rows whose northern edge lies over the first latitude and up to the second,
# in columns whose eastern edge lies over the first longitude and up to the second; degrees.
NO_LAKES = ((-91.0, -60.0, -181.0, 180.0), (78.0, 90.0, -181.0, 180.0), (74.0, 90.0, -181.0, 0.0))
# In southern Greenland: rows from 60 to 75 N, columns east of 60 W up to an edge that rises by three quarters of a
# column a row, counted from three tenths of all rows.
GREENLAND_LAKES, EDGE_START, EDGE_RISE = (60.0, 75.0, -60.0), 0.3, 0.75
# Fixed value: mean thickness of ice, in metres, where nothing states it.
MEAN_THICKNESS = 264.7


def no_lakes(idx: Column, g: HntrSpec) -> Column:
    """Where lakes are not kept: poleward of 60 S and 78 N, west of Greenwich beyond 74 N, southern Greenland."""
    row, col = _row(idx, g) + 1, F.pmod(idx, F.lit(g.im)) + 1
    north, east, eps = row * (180.0 / g.jm) - 90, col * (360.0 / g.im) - 180, 1e-9
    s, n, w = GREENLAND_LAKES
    edge = F.floor((row - g.jm * EDGE_START) * (EDGE_RISE * g.im / g.jm) + 0.5)
    out = (north >= s - eps) & (north <= n + eps) & (east > w + eps) & (col <= edge)
    for lat0, lat1, lon0, lon1 in NO_LAKES:
        out = out | ((north > lat0 + eps) & (north <= lat1 + eps) & (east > lon0 + eps) & (east <= lon1 + eps))
    return out


def make_topoo(fine: DataFrame, lakes: DataFrame, g: HntrSpec, lake_grid: HntrSpec, ocean: HntrSpec, overrides: DataFrame | None = None, lake_levels: DataFrame | None = None, total_ice: float = MEAN_THICKNESS) -> DataFrame:
    """Topography on the ocean grid, one row a cell.

    ``fine (idx, focean, fgice, zicetop, zsolg)`` on a grid that nests in the ocean
    grid, ``lakes (idx, flake)``. Cells at least half ocean become ocean, except
    where ``overrides (idx, to)`` says ``ocean`` or ``land``; the row at the south pole
    is ice. ``lake_levels (idx, elev)`` sets lake surfaces by hand. Fractional values
    are kept as ``foceanf, fgicef, zatmof``.
    """
    spark = fine.sparkSession
    x = regrid_many(fine.select("idx", F.col("focean").alias("foceanf"), F.col("fgice").alias("fgicef")), ("foceanf", "fgicef"), ocean, g, mean_polar=True)
    wet_ground = fine.select("idx", "focean", F.col("zsolg").alias("zsolg_focean"))
    iced = fine.select("idx", "fgice", F.col("zicetop").alias("zicetop_fgice"), F.col("zsolg").alias("zsolg_fgice"))
    x = x.join(regrid_many(wet_ground, ("zsolg_focean",), ocean, g, "focean", True).fillna(0.0), "idx")
    x = x.join(regrid_many(iced, ("zicetop_fgice", "zsolg_fgice"), ocean, g, "fgice", True).fillna(0.0), "idx")
    x = x.join(regrid_many(lakes.select("idx", F.col("flake").alias("lake")), ("lake",), ocean, lake_grid, mean_polar=True).fillna(0.0), "idx")
    o = overrides if overrides is not None else spark.createDataFrame([], "idx long, to string")
    x = x.join(o, "idx", "left")
    pole = _row(F.col("idx"), ocean) == 0
    wet = F.when(F.col("to") == "ocean", True).when(F.col("to") == "land", False).otherwise(F.col("foceanf") >= 0.5) & ~pole
    x = x.withColumns({"focean": F.when(wet, 1.0).otherwise(0.0), "fgicef": F.when(pole, 1.0).otherwise(F.col("fgicef"))})
    ice = F.when(pole, 1.0).when(F.col("focean") == 1, 0.0).otherwise(F.coalesce(F.try_divide("fgicef", 1 - F.col("foceanf")), F.lit(0.0)))
    lake = F.when(no_lakes(F.col("idx"), ocean), 0.0).otherwise(F.coalesce("lake", F.lit(0.0)))
    cont, contf = 1 - F.col("focean"), 1 - F.col("foceanf")
    x = x.withColumns({"fgice": F.least(F.greatest(ice, F.lit(0.0)), F.lit(1.0)), "flake": F.when(contf != 0, F.round(F.try_divide(lake * cont, contf) * 256) / 256).otherwise(lake)})
    x = x.withColumn("flake", F.greatest(F.lit(0.0), F.least(F.col("flake"), 1 - F.col("fgice") - F.col("focean"))))
    rest = 1 - F.col("focean") - F.col("flake") - F.col("fgice")
    x = x.withColumn("fgrnd", F.when(F.abs(rest) < topo.SNAP, 0.0).otherwise(rest)).withColumn("dzocen", -F.col("zsolg_focean") * F.col("focean"))
    x = _thickness(x, ocean, total_ice)
    cells = fine.select(nested_parent(F.col("idx"), g, ocean).alias("block"), cell_area(F.col("idx"), g).alias("area"), F.col("zicetop").alias("depth"), F.col("focean").cast("int").alias("ocean"), (F.col("fgice") != 0).cast("int").alias("ice"))
    z = topo.z_statistics(cells, x.select(F.col("idx").alias("block"), "focean", "flake", "fgrnd")).withColumnRenamed("block", "idx")
    x = x.join(z, "idx", "left").withColumn("zsoldg", F.coalesce("zsoldg", -F.col("dzocen"))).fillna(0.0, ["zatmo", "zlake", "dzlake", "zgrnd", "zsglo", "zsghi", "zicetop", "zatmof"])
    if lake_levels is not None:
        x = x.join(lake_levels.select("idx", F.col("elev").alias("level")), "idx", "left")
        x = x.withColumns({"dzlake": F.when(F.col("level").isNull(), F.col("dzlake")).otherwise(F.col("dzlake") + F.col("level") - F.col("zlake")), "zatmo": F.coalesce("level", "zatmo"), "zlake": F.coalesce("level", "zlake")})
    x = x.withColumns({"j": _row(F.col("idx"), ocean), "i": F.pmod("idx", F.lit(ocean.im)).cast("int"), "had": F.col("flake")})
    x = topo.lake_near_ocean(x).withColumn("dzlake", F.when((F.col("had") > 0) & (F.col("flake") == 0), 0.0).otherwise(F.col("dzlake")))
    return x.select("idx", "j", "i", "focean", "flake", "fgrnd", "fgice", "zatmo", "dzocen", "dzlake", "dzgice", "zsoldg", "zicetop", "zsglo", "zlake", "zgrnd", "zsghi", "foceanf", "fgicef", "zatmof")


def _thickness(x: DataFrame, g: HntrSpec, total: float) -> DataFrame:
    """``dzgice``: the ice top less the ground where they differ, elsewhere the one-constant law in the share of land that is ice."""
    own = F.col("zicetop_fgice") - F.col("zsolg_fgice")
    x = x.withColumns({"own": own, "law": F.pow(F.coalesce(F.try_divide(F.col("fgice"), 1 - F.col("focean")), F.lit(0.0)), F.lit(0.3))})
    area = F.when(F.col("own") == 0, cell_area(F.col("idx"), g) * F.col("fgice")).otherwise(0.0)
    c = x.agg(F.coalesce(F.try_divide(F.sum(area) * total, F.sum(area * F.col("law"))), F.lit(0.0)).alias("c"))
    return x.join(F.broadcast(c)).withColumn("dzgice", F.when(F.col("fgice") == 0, 0.0).when(F.col("own") != 0, F.col("own")).otherwise(F.col("c") * F.col("law"))).drop("own", "law", "c")


FIELDS = ("focean", "flake", "fgrnd", "fgice", "zatmo", "zlake")


def make_topoa(topoo: DataFrame, a_v_e: DataFrame, hcdefs: list[float], underice: list[int], ocean: HntrSpec, atmosphere: HntrSpec) -> tuple[DataFrame, DataFrame]:
    """Topography on the atmosphere grid, and its elevation classes.

    ``topoo (idx, focean, flake, fgrnd, fgice, zatmo, zlake, zicetop, zland_min,
    zland_max, mergemask)``; ``a_v_e`` is the matrix A <- E, keys ``ihc * n_a + a``, which
    must join each cell to its own classes only. Returns ``(idx, ...)`` with the same
    fields, and ``(cell, ihc, elev, fhc, underice)`` for every class and one more, the
    land of the sea-land segment at the height of the atmosphere's surface.
    """
    n_a = atmosphere.size
    out = regrid_many(topoo, FIELDS, atmosphere, ocean)
    top = regrid_many(topoo, ("zicetop",), atmosphere, ocean, weight="fgice").fillna(0.0)
    pairs = overlap_matrix(topoo.sparkSession, atmosphere, ocean, scaled=True)
    mm = topo.min_max_mask(pairs, topoo.select("idx", F.col("zland_min").alias("zmin"), F.col("zland_max").alias("zmax"), F.col("mergemask").alias("mask")))
    out = out.join(top, "idx").join(mm.select(F.col("row").alias("idx"), F.col("zmin").alias("zland_min"), F.col("zmax").alias("zland_max"), F.col("mask").alias("mergemask")), "idx")
    for f in (*FIELDS, "zicetop", "zland_min", "zland_max"):  # windows over one partitioning: one exchange
        out = topo.merge_poles(out, atmosphere.im, atmosphere.jm, f)
    stray = F.when(F.pmod("col", F.lit(n_a)) == F.col("row"), F.col("val")).otherwise(F.raise_error(F.lit("the matrix joins a cell to another cell's classes")).cast("double"))
    codes = F.array(*(F.lit(int(u)) for u in underice))
    ihc = F.floor(F.col("col") / n_a).cast("int")
    fhc = a_v_e.select(F.col("row").alias("cell"), ihc.alias("ihc"), stray.alias("v")).groupBy("cell", "ihc").agg(F.sum("v").alias("fhc")).withColumn("underice", F.get(codes, F.col("ihc")))
    cells = out.select(F.col("idx").alias("cell"), "focean", "fgice", "zatmo", "zland_min", "zland_max")
    # the south pole is one cell: its classes are means over its row
    south = F.expr(f"cell div {atmosphere.im}") == 0
    polar = fhc.filter(south).groupBy("ihc").agg((F.sum("fhc") / atmosphere.im).alias("fhc"), F.max("underice").alias("underice"))
    fhc = fhc.filter(~south).unionByName(cells.filter(south).select("cell").join(F.broadcast(polar)))
    n_local = next((k for k, u in enumerate(underice) if u != topo.UI_LOCALICE), len(underice))
    every = topo.ghost_classes(cells, fhc, hcdefs)
    # ghosts belong to the classes of local ice alone
    over = (F.col("ihc") >= n_local) & (F.col("underice") == topo.UI_VGHOST)
    every = every.withColumns({"fhc": F.when(over, 0.0).otherwise(F.col("fhc")), "underice": F.when(over, topo.UI_UNUSED).otherwise(F.col("underice"))})
    some = F.col("fgice") > 0
    land = cells.select("cell", F.lit(len(hcdefs)).alias("ihc"), F.col("zatmo").alias("elev"), F.when(some, topo.GHOST).otherwise(0.0).alias("fhc"), F.when(some, topo.UI_SEALAND).otherwise(topo.UI_UNUSED).alias("underice"))
    return out, every.unionByName(land)


def check_topoa(topoa: DataFrame, classes: DataFrame) -> None:
    """Raise unless land fractions sum to 1 and class shares to 0 or 1."""
    topo.require_none(topo.bad_land_fractions(topoa, 1e-12), "land fractions")
    topo.require_none(topo.bad_class_fractions(classes, 1e-12), "class fractions")


def nearest_class_values(field_e: DataFrame, elevations: DataFrame, hcdefs: list[float], n_a: int) -> DataFrame:
    """``(idx, value)``: for each cell ``(idx, a_id, elev)`` the value of the class of its A cell that is nearest in height."""
    from ..operators.elevation import nearest

    x = nearest(elevations, hcdefs).select("idx", (F.col("ihc").cast("long") * n_a + F.col("a_id")).alias("e"))
    return x.join(field_e.select(F.col("idx").alias("e"), "value"), "e").select("idx", "value")
