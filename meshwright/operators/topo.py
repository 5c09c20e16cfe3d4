"""Topography operators: budget fills, lake levels, ghost classes, merging, sanity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codes of what lies under the ice of an elevation class.
UI_UNUSED, UI_LOCALICE, UI_GLOBALICE, UI_SEALAND, UI_VGHOST, UI_HGHOST = range(6)
GHOST = 1e-30
SNAP = 1e-14
# Fixed value: mean thickness of ice, in metres, where nothing states it.
MEAN_THICKNESS = 264.7


def budget_fill(cells: DataFrame, budgets: DataFrame) -> DataFrame:
    """Fill each block's budget of area from its highest cells down.

    ``cells (block, j, i, elev, area)``, ``budgets (block, budget)``. Adds ``filled``:
    cells are taken while their running area fits; the first that does not is taken
    if at least half of it fits, and nothing after it. Cells tie by whole metres of
    elevation, then j, i. Blocks without a positive budget fill nothing.
    """
    order = Window.partitionBy("block").orderBy(F.expr("cast(-elev as int)"), "j", "i")
    upto = F.sum("area").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = cells.withColumn("upto", upto).join(budgets, "block", "left").withColumn("budget", F.coalesce("budget", F.lit(0.0)))
    fits = F.col("upto") <= F.col("budget")
    last = (F.col("upto") - F.col("area") <= F.col("budget")) & (F.col("budget") - (F.col("upto") - F.col("area")) >= F.col("area") / 2)
    return rows.withColumn("filled", (F.col("budget") > 0) & (fits | last)).drop("upto", "budget")


def z_statistics(cells: DataFrame, fractions: DataFrame) -> DataFrame:
    """Land statistics of coarse cells from the fine cells in them.

    ``cells (block, area, depth, ocean, ice)``: fine cells, ``ocean`` and ``ice`` 0/1.
    ``fractions (block, focean, flake, fgrnd)``. For continental blocks: area means
    of all land (``zatmof``, ``zsoldg``) and of ice (``zicetop``, 0 without any), lowest
    and highest land, and by the running area of the land from the bottom up: the
    lake level ``zlake`` where it exceeds the lake's area, its depth ``dzlake`` (1 at
    least), the mean ``zatmo`` of the surface with the lake filled in, and
    ``zgrnd`` where it exceeds lake and ground. Ocean blocks have only
    ``zatmof``, over their whole area, and ``zicetop``.
    """
    land = cells.filter("ocean = 0").withColumn("az", F.col("area") * F.col("depth"))
    order = Window.partitionBy("block").orderBy("depth", "area")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("block")
    rows = land.join(fractions, "block").withColumns({"ansum": F.sum("area").over(run), "vnsum": F.sum("az").over(run), "sarea": F.sum("area").over(whole), "n": F.row_number().over(order), "last": F.count("*").over(whole)})
    at = lambda limit: (F.col("ansum") > F.col("sarea") * limit) | (F.col("n") == F.col("last"))
    first = lambda limit, what: F.min_by(what, F.when(at(limit), F.col("n")))
    lake, both = F.col("flake"), F.col("flake") + F.col("fgrnd")
    ice = F.when(F.col("ice") != 0, F.col("area"))
    agg = rows.groupBy("block").agg(
        F.first("focean").alias("focean"), F.first("flake").alias("flake"), F.first("sarea").alias("sarea"), F.sum("az").alias("saz"),
        F.try_divide(F.sum(ice * F.col("depth")), F.sum(ice)).alias("zice"), F.min("depth").alias("lo"), F.max("depth").alias("hi"),
        first(lake, F.struct("depth", "ansum", "vnsum")).alias("k"), first(both, F.col("depth")).alias("zg"),
    )
    area = cells.groupBy("block").agg(F.sum("area").alias("all_area"))
    agg = fractions.select("block", F.col("focean").alias("fo")).join(area, "block").join(agg.drop("focean"), "block", "left")
    wet = F.col("flake") * F.col("sarea")
    bottom = F.try_divide(F.col("k.vnsum") - (F.col("k.ansum") - wet) * F.col("k.depth"), wet)
    continent = lambda c: F.when(F.col("fo") < 1, c)
    return agg.select(
        "block",
        F.coalesce(F.try_divide("saz", F.when(F.col("fo") < 1, F.col("sarea")).otherwise(F.col("all_area"))), F.lit(0.0)).alias("zatmof"),
        F.coalesce("zice", F.lit(0.0)).alias("zicetop"),
        continent(F.try_divide("saz", "sarea")).alias("zsoldg"), continent(F.col("lo")).alias("zsglo"), continent(F.col("hi")).alias("zsghi"),
        continent(F.col("k.depth")).alias("zlake"),
        continent(F.when(F.col("flake") > 0, F.greatest(F.col("k.depth") - bottom, F.lit(1.0))).otherwise(0.0)).alias("dzlake"),
        continent(F.try_divide(F.col("k.ansum") * F.col("k.depth") + F.col("saz") - F.col("k.vnsum"), F.col("sarea"))).alias("zatmo"),
        continent(F.col("zg")).alias("zgrnd"),
    )


def merge_poles(field: DataFrame, im: int, jm: int, value: str = "value") -> DataFrame:
    """``(idx, value)`` with the first and the last row replaced by their plain mean."""
    j = F.expr(f"idx div {im}")
    mean = F.avg(value).over(Window.partitionBy(j))
    return field.withColumn(value, F.when((j == 0) | (j == jm - 1), mean).otherwise(F.col(value)))


def block_any(cells: DataFrame, flag: Column, size: int = 2, name: str = "any") -> DataFrame:
    """``(j, i, ...)`` with whether ``flag`` holds anywhere in the cell's block of ``size`` x ``size``."""
    w = Window.partitionBy(F.expr(f"j div {size}"), F.expr(f"i div {size}"))
    return cells.withColumn(name, F.max(flag.cast("int")).over(w) == 1)


def lake_near_ocean(cells: DataFrame) -> DataFrame:
    """Lakes in a 2 x 2 block with any ocean become ground: ``(j, i, focean, flake, fgrnd)``."""
    wet = block_any(cells, F.col("focean") > 0, 2, "_wet")
    gone = F.col("_wet") & (F.col("flake") > 0)
    return wet.withColumns({"fgrnd": F.when(gone, F.col("fgrnd") + F.col("flake")).otherwise(F.col("fgrnd")), "flake": F.when(gone, 0.0).otherwise(F.col("flake"))}).drop("_wet")


def neighbour_ocean(cells: DataFrame, im: int, jm: int) -> DataFrame:
    """Single ocean cells between four land cells, off the edges and not wholly ocean, become land.

    ``(j, i, focean_m, focean_p, fgice_p, zatmo_p, flake_m)`` gains the new ``focean_m,
    fgice_m, fgrnd_m, zatmo_m`` (null where unchanged) and ``changed``. A changed
    cell's neighbours are land, so none of them changes and one pass is exact.
    """
    row, col = Window.partitionBy("j").orderBy("i"), Window.partitionBy("i").orderBy("j")
    dry = lambda w, k, axis: (F.lag("focean_m", k).over(w) == 0) & (F.lag(axis, k).over(w) == F.col(axis) - k)
    land = dry(row, 1, "i") & dry(row, -1, "i") & dry(col, 1, "j") & dry(col, -1, "j")
    inner = (F.col("i") > 0) & (F.col("i") < im - 1) & (F.col("j") > 0) & (F.col("j") < jm - 1)
    changed = F.coalesce(inner & land & (F.col("focean_m") == 1) & (F.col("focean_p") != 1), F.lit(False))
    out = cells.withColumn("changed", changed)
    fact = F.try_divide(F.lit(1.0), 1 - F.col("focean_p"))
    new = lambda c: F.when(F.col("changed"), c)
    return out.withColumns({"fgice_m": new(F.col("fgice_p") * fact), "fgrnd_m": new(1 - F.col("fgice_p") * fact - F.col("flake_m")), "zatmo_m": new(F.col("zatmo_p") * fact), "focean_m": F.when(F.col("changed"), 0.0).otherwise(F.col("focean_m"))})


def ghost_classes(cells: DataFrame, fhc: DataFrame, hcdefs: list[float]) -> DataFrame:
    """``(cell, ihc, elev, fhc, underice)`` of cells (``cell, focean, zland_min, zland_max``) with their classes' shares (``cell, ihc, fhc, underice``).

    On cells that are not wholly ocean, classes without a share become ghosts of
    1e-30 from one below the highest class under the lowest land to two above the
    highest one under the highest land. Without a class under the lowest land, or
    without any land elevation, there are none.
    """
    n = len(hcdefs)
    points = F.array(*(F.lit(float(h)) for h in hcdefs))
    lowest = F.size(F.filter(points, lambda h: h < F.col("zland_min"))) - 1
    highest = F.size(F.filter(points, lambda h: h <= F.col("zland_max"))) - 1
    base = cells.withColumns({"lo": lowest, "hi": highest})
    grid = base.select("*", F.posexplode(points).alias("ihc", "elev"))
    joined = grid.join(fhc, ["cell", "ihc"], "left")
    ghost = (F.abs(F.col("focean") - 1) > SNAP) & (F.col("lo") >= 0) & (F.col("hi") >= 0) & (F.col("ihc") >= F.greatest(F.col("lo") - 1, F.lit(0))) & (F.col("ihc") <= F.least(F.col("hi") + 2, F.lit(n - 1)))
    empty = F.coalesce("fhc", F.lit(0.0)) == 0
    ghost = F.coalesce(ghost, F.lit(False)) & empty
    out = joined.select("cell", "ihc", "elev", F.when(ghost, GHOST).otherwise(F.coalesce("fhc", F.lit(0.0))).alias("fhc"), F.when(ghost, UI_VGHOST).otherwise(F.coalesce("underice", F.lit(UI_UNUSED))).alias("underice"))
    return out


def min_max_mask(m: DataFrame, cells: DataFrame) -> DataFrame:
    """``(row, zmin, zmax, mask)`` over the cells (``idx, zmin, zmax, mask``) that a matrix joins to each row; only masked-in cells give elevations."""
    x = m.join(cells.withColumnRenamed("idx", "col"), "col")
    on = F.col("mask") != 0
    return x.groupBy("row").agg(F.min(F.when(on, F.col("zmin"))).alias("zmin"), F.max(F.when(on, F.col("zmax"))).alias("zmax"), F.max("mask").alias("mask"))


def land_fractions(cells: DataFrame) -> DataFrame:
    """Clamp lake and ice fractions, snap those below 1e-14, round them to 1/256, and let ground be the rest."""
    q = lambda c: F.round(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * 256) / 256
    s = lambda c: F.when(F.abs(c) < SNAP, 0.0).otherwise(c)
    out = cells.withColumns({"flake": s(q("flake")), "fgice": s(q("fgice"))})
    out = out.withColumn("flake", F.least(F.col("flake"), 1 - F.col("focean"))).withColumn("fgice", F.least(F.col("fgice"), 1 - F.col("focean") - F.col("flake")))
    return out.withColumn("fgrnd", s(1 - F.col("focean") - F.col("flake") - F.col("fgice")))


def ice_thickness(cells: DataFrame, total: float = MEAN_THICKNESS) -> DataFrame:
    """``thick = c * rgice ** 0.3`` on ``(idx, area, fgice, rgice)``, the one constant ``c`` making the area mean over ice ``total``."""
    on = (F.col("fgice") > 0) & (F.col("rgice") > 0)
    law = F.when(on, F.pow("rgice", F.lit(0.3))).otherwise(0.0)
    rows = cells.withColumn("_law", law)
    iced = F.col("area") * F.col("fgice")
    c = rows.agg(F.try_divide(F.sum(iced) * total, F.sum(iced * F.col("_law"))).alias("_c"))
    return rows.join(F.broadcast(c)).withColumn("thick", F.col("_law") * F.col("_c")).drop("_law", "_c")


def merge_sheets(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Add local ice sheets to ocean-grid topography.

    ``cells (idx, area, focean_p, fgice_p, zatmo_p, zicetop, focean_m, flake_m, fgrnd_m,
    fgice_m, zatmo_m)``; ``sheets (idx, da_cont, da_ice, da_zatmo, da_zicetop)``, a row
    for each sheet and cell, summed first. Cells that become more than half land
    turn from ocean to land in the masked fields.
    """
    names = ("da_cont", "da_ice", "da_zatmo", "da_zicetop")
    total = sheets.groupBy("idx").agg(*(F.sum(c).alias(c) for c in names))
    x = cells.join(total, "idx", "left").fillna(0.0, list(names))
    by, some = F.try_divide(F.lit(1.0), F.col("area")), F.col("da_cont") != 0
    keep = lambda new, old: F.when(some, new).otherwise(F.col(old))
    x = x.withColumn("dice", F.col("da_ice") * by).withColumns({"fgice_0": F.col("fgice_p"), "fgice_p": keep(F.col("fgice_p") + F.col("da_ice") * by, "fgice_p"), "focean_p": keep(F.col("focean_p") - F.col("da_cont") * by, "focean_p"), "zatmo_p": keep(F.col("zatmo_p") + F.col("da_zatmo") * by, "zatmo_p")})
    top = F.try_divide(F.col("zicetop") * F.col("fgice_0") + F.col("da_zicetop") * by * F.col("dice"), F.col("fgice_p"))
    turned = some & (F.col("focean_p") < 0.5) & (F.col("focean_m") == 1)
    fact = F.try_divide(F.lit(1.0), 1 - F.col("focean_p"))
    x = x.withColumn("zicetop", F.when(some & (F.col("fgice_p") != 0), top).otherwise(F.col("zicetop"))).withColumn("turned", turned)
    new = lambda c, old: F.when(F.col("turned"), c).otherwise(F.col(old))
    x = x.withColumns({"fgice_m": new(F.col("fgice_p") * fact, "fgice_m"), "zatmo_m": new(F.col("zatmo_p") * fact, "zatmo_m"), "focean_m": new(F.lit(0.0), "focean_m")})
    x = x.withColumn("fgrnd_m", new(1 - F.col("fgice_m") - F.col("flake_m"), "fgrnd_m"))
    merged = F.col("turned") | (F.col("da_zicetop") != 0) | (some & (F.col("dice") != 0))
    return x.withColumn("mergemask", merged.cast("int")).drop(*names, "dice", "fgice_0", "turned")


def sheet_deltas(exchange: DataFrame, areas: DataFrame, ice: DataFrame, land: DataFrame) -> DataFrame:
    """What one ice sheet adds to the cells of the ocean grid, as ``merge_sheets`` takes it.

    ``exchange (a_id, i_id, area)``, ``areas (a_id, native_area, proj_area)``, ``ice`` and
    ``land (i_id, elev)`` without the masked cells. Returns ``(idx, da_cont, da_ice,
    da_zatmo, da_zicetop, zland_min, zland_max)``: areas in native units, and mean
    elevations times the cell's whole native area.
    """
    x = exchange.filter("area > 0")

    def part(mask: DataFrame, name: str) -> DataFrame:
        on = x.join(mask.select("i_id", "elev"), "i_id").groupBy("a_id").agg(F.sum("area").alias("s"), F.sum(F.col("area") * F.col("elev")).alias("z"), F.min("elev").alias("lo"), F.max("elev").alias("hi"))
        on = on.join(areas, "a_id")
        return on.select(F.col("a_id").alias("idx"), (F.col("s") * F.try_divide("native_area", "proj_area")).alias(f"{name}_area"), (F.try_divide("z", "s") * F.col("native_area")).alias(f"{name}_z"), F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"))

    both = part(land, "land").join(part(ice, "ice"), "idx", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select("idx", zero("land_area").alias("da_cont"), zero("ice_area").alias("da_ice"), zero("land_z").alias("da_zatmo"), zero("ice_z").alias("da_zicetop"), F.col("land_lo").alias("zland_min"), F.col("land_hi").alias("zland_max"))


def fill_shares(cells: DataFrame, budgets: DataFrame) -> DataFrame:
    """Like ``budget_fill`` with ``share``, the part of each cell's area that the budget reaches, and ``filled``, that part rounded.

    Cells tie by their exact elevation, then j, i.
    """
    order = Window.partitionBy("block").orderBy(F.col("elev").desc(), "j", "i")
    upto = F.sum("area").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = cells.withColumn("upto", upto).join(budgets, "block", "left").withColumn("budget", F.coalesce("budget", F.lit(0.0)))
    rest = F.col("budget") - F.col("upto") + F.col("area")
    share = F.coalesce(F.least(F.greatest(F.try_divide(rest, F.col("area")), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return rows.withColumn("share", share).withColumn("filled", F.col("share") >= 0.5).drop("upto", "budget")


def sent_classes(classes: DataFrame) -> DataFrame:
    """The classes that lie over ice, local or global; only these get values from a climate model."""
    return classes.filter(F.col("underice").isin(UI_LOCALICE, UI_GLOBALICE))


def base_weights(weights: DataFrame, offset: int) -> DataFrame:
    """``(idx, w)`` of the classes that were stacked behind ``offset`` local ones' keys."""
    return weights.filter(F.col("idx") >= offset)


# -- checks ---------------------------------------------------------------------------------------------------------
def bad_land_fractions(cells: DataFrame, tolerance: float = 1e-13) -> DataFrame:
    """Rows whose ``focean + flake + fgrnd + fgice`` is not 1."""
    total = F.col("focean") + F.col("flake") + F.col("fgrnd") + F.col("fgice")
    return cells.withColumn("total", total).filter(F.col("total").isNull() | (F.abs(F.col("total") - 1) > tolerance))


def bad_class_fractions(fhc: DataFrame, tolerance: float = 1e-13) -> DataFrame:
    """``(cell, total)`` of cells whose shares, ghosts aside, sum neither to 0 nor to 1."""
    total = fhc.groupBy("cell").agg(F.sum(F.when(F.col("fhc") != GHOST, F.col("fhc")).otherwise(0.0)).alias("total"))
    return total.filter((F.abs("total") > tolerance) & (F.abs(F.col("total") - 1) > tolerance))


def bad_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(name, n_null, n_nan, n_inf, n_zero, n_negative)``, a row for each column."""
    rows = df.agg(*(F.struct(F.lit(c).alias("name"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.isnan(c)).alias("n_nan"), F.count_if(F.abs(F.col(c)) == float("inf")).alias("n_inf"), F.count_if(F.col(c) == 0).alias("n_zero"), F.count_if((F.col(c) < 0) & ~F.isnan(c)).alias("n_negative")).alias(c) for c in columns))
    return rows.select(F.explode(F.array(*(F.col(c) for c in columns))).alias("x")).select("x.*")


def require_none(bad: DataFrame, what: str) -> None:
    """Raise if a check found any row, naming some of them."""
    rows = bad.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")
