"""Overlaps of regular longitude/latitude grids, as two one-dimensional interval joins.

The area that two cells share is (share of longitude) x (share of sine of
latitude), so the sparse overlap never needs a join over cells: each axis is a
table of at most a few times im or jm rows, made by arithmetic and broadcast. A
field meets the latitude table on its row and the longitude table on its column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grids import HntrSpec

#: Overlaps smaller than this, in units of a cell's width or of sine of latitude, are rounding.
SLIVER = 1e-12
#: The longest axis table that is broadcast; finer axes are joined by shuffle.
MAX_BROADCAST = 1 << 20


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def lon_overlap(spark: SparkSession, b: HntrSpec, a: HntrSpec) -> DataFrame:
    """``(ib, ia, f)``: ``f`` of the width of source column ``ia`` lies in column ``ib``; 0-based, around the globe."""
    lo = (F.col("ib") + F.lit(float(b.offi))) * a.im
    cols = spark.range(b.im).select(F.col("id").cast("int").alias("ib")).withColumn("lo", lo).withColumn("hi", F.col("lo") + a.im)
    first, last = F.floor(F.col("lo") / b.im - a.offi) - 1, F.ceil(F.col("hi") / b.im - a.offi) + 1
    cells = cols.select("ib", "lo", "hi", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("k"))
    west = (F.col("k") + F.lit(float(a.offi))) * b.im
    shared = (F.least(F.col("hi"), west + b.im) - F.greatest(F.col("lo"), west)) / b.im
    cells = cells.select("ib", F.pmod("k", F.lit(a.im)).cast("int").alias("ia"), shared.alias("f")).filter(F.col("f") > SLIVER)
    return cells.groupBy("ib", "ia").agg(F.sum("f").alias("f"))


def _edge(j: Column, g: HntrSpec) -> Column:
    import math

    inner = F.sin((j - g.jm / 2) * (g.dlat * math.pi / 10800))
    return F.when(j <= 0, F.lit(-1.0)).when(j >= g.jm, F.lit(1.0)).otherwise(inner)


def lat_overlap(spark: SparkSession, b: HntrSpec, a: HntrSpec) -> DataFrame:
    """``(jb, ja, g)``: the extent in sine of latitude that rows ``jb`` and ``ja`` share; 0-based, reaching to the poles."""
    rows = spark.range(b.jm).select(F.col("id").cast("int").alias("jb"))
    near = lambda j: F.floor((j - b.jm / 2) * (b.dlat / a.dlat) + a.jm / 2).cast("int")
    clip = lambda j: F.least(F.greatest(j, F.lit(0)), F.lit(a.jm - 1))
    first = F.when(F.col("jb") == 0, 0).otherwise(clip(near(F.col("jb")) - 1))
    last = F.when(F.col("jb") == b.jm - 1, a.jm - 1).otherwise(clip(near(F.col("jb") + 1) + 1))
    pairs = rows.select("jb", F.explode(F.sequence(first, last)).alias("ja"))
    shared = F.least(_edge(F.col("jb") + 1, b), _edge(F.col("ja") + 1, a)) - F.greatest(_edge(F.col("jb"), b), _edge(F.col("ja"), a))
    return pairs.select("jb", "ja", shared.alias("g")).filter(F.col("g") > SLIVER)


def overlap_matrix(spark: SparkSession, b: HntrSpec, a: HntrSpec, radius: float = 1.0, include: DataFrame | None = None, scaled: bool = False) -> DataFrame:
    """``(row, col, val)`` between cells of ``b`` and ``a``: shared areas, or with ``scaled`` the shares of each row, which sum to 1.

    ``include`` (``row``) restricts the rows before any pair is made.
    """
    lon = lon_overlap(spark, b, a).withColumn("f", F.col("f") / F.sum("f").over(Window.partitionBy("ib")))
    lat = lat_overlap(spark, b, a).withColumn("g", F.col("g") / F.sum("g").over(Window.partitionBy("jb")))
    if not scaled:
        import math

        dlat = math.pi / b.jm
        j = F.col("jb")
        area = radius * radius * 2 * math.pi / b.im * (F.sin((j + 1 - b.jm / 2) * dlat) - F.sin((j - b.jm / 2) * dlat))
        lat = lat.withColumn("g", F.col("g") * area)
    cells = spark.range(b.size).withColumnRenamed("id", "row") if include is None else include.select(F.col("row").cast("long").alias("row"))
    cells = cells.select("row", F.pmod("row", F.lit(b.im)).cast("int").alias("ib"), F.expr(f"cast(row div {b.im} as int)").alias("jb"))
    out = cells.join(_small(lat, b.jm + a.jm), "jb").join(_small(lon, b.im + a.im), "ib")
    return out.select("row", (F.col("ja").cast("long") * a.im + F.col("ia")).alias("col"), (F.col("f") * F.col("g")).alias("val"))


def regrid(fields: DataFrame, b: HntrSpec, a: HntrSpec, wtm: float = 1.0, wtb: float = 0.0, missing: float | None = None, mean_polar: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean of a field: ``(*by, idx, value, weight)`` on ``a`` to ``(*by, idx, value)`` on ``b``, indices 0-based.

    A source cell counts with its shared area times ``wtm * weight + wtb``. Cells
    whose weights sum to zero get ``missing`` (none: null), as do cells without any
    source row. With ``mean_polar`` the first and the last row become their plain
    mean, or missing if any of their cells is. The field shuffles twice, partial
    sums first: by row of ``b``, then by cell.
    """
    spark = fields.sparkSession
    w = F.col("weight") * wtm + wtb
    src = fields.select(*by, F.expr(f"cast(idx div {a.im} as int)").alias("ja"), F.pmod("idx", F.lit(a.im)).cast("int").alias("ia"), "value", w.alias("w"))
    src = src.join(_small(lat_overlap(spark, b, a), a.jm + b.jm), "ja")
    wv = F.col("g") * F.col("w") * F.coalesce("value", F.lit(0.0))
    wt = F.when(F.col("value").isNull(), 0.0).otherwise(F.col("g") * F.col("w"))
    rows = src.groupBy(*by, "jb", "ia").agg(F.sum(wv).alias("wv"), F.sum(wt).alias("wt"))
    cells = rows.join(_small(lon_overlap(spark, b, a), a.im + b.im), "ia")
    sums = cells.groupBy(*by, (F.col("jb").cast("long") * b.im + F.col("ib")).alias("idx")).agg(F.sum(F.col("wv") * F.col("f")).alias("wv"), F.sum(F.col("wt") * F.col("f")).alias("wt"))
    if by:
        every = sums.select(*by).distinct().crossJoin(spark.range(b.size).withColumnRenamed("id", "idx"))
        sums = every.join(sums, [*by, "idx"], "left")
    else:
        sums = spark.range(b.size).withColumnRenamed("id", "idx").join(sums, "idx", "left")
    value = F.try_divide(F.col("wv"), F.when(F.col("wt") != 0, F.col("wt")))
    out = sums.select(*by, "idx", value.alias("value"))
    if mean_polar:
        j = F.expr(f"idx div {b.im}")
        row = Window.partitionBy(*by, j)
        mean = F.when(F.count("value").over(row) == b.im, F.avg("value").over(row))
        out = out.withColumn("value", F.when((j == 0) | (j == b.jm - 1), mean).otherwise(F.col("value")))
    return out if missing is None else out.withColumn("value", F.coalesce("value", F.lit(float(missing))))


def regrid_many(fields: DataFrame, columns: tuple[str, ...], b: HntrSpec, a: HntrSpec, weight: str | None = None, mean_polar: bool = False) -> DataFrame:
    """``(idx, *columns)`` of several fields with common weights (1 without ``weight``), in the two shuffles that one takes."""
    spark = fields.sparkSession
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    src = fields.select(F.expr(f"cast(idx div {a.im} as int)").alias("ja"), F.pmod("idx", F.lit(a.im)).cast("int").alias("ia"), w.alias("_w"), *(F.col(c).cast("double").alias(c) for c in columns))
    src = src.join(_small(lat_overlap(spark, b, a), a.jm + b.jm), "ja")
    share = F.col("g") * F.col("_w")
    parts = [x for c in columns for x in (F.sum(share * F.col(c)).alias(f"v_{c}"), F.sum(F.when(F.col(c).isNotNull(), share)).alias(f"t_{c}"))]
    cells = src.groupBy("jb", "ia").agg(*parts).join(_small(lon_overlap(spark, b, a), a.im + b.im), "ia")
    sums = cells.groupBy((F.col("jb").cast("long") * b.im + F.col("ib")).alias("idx")).agg(*(F.sum(F.col(f"{k}_{c}") * F.col("f")).alias(f"{k}_{c}") for c in columns for k in "vt"))
    out = spark.range(b.size).withColumnRenamed("id", "idx").join(sums, "idx", "left")
    out = out.select("idx", *(F.try_divide(F.col(f"v_{c}"), F.when(F.col(f"t_{c}") != 0, F.col(f"t_{c}"))).alias(c) for c in columns))
    if mean_polar:
        j = F.expr(f"idx div {b.im}")
        row = Window.partitionBy(j)
        mean = lambda c: F.when(F.count(c).over(row) == b.im, F.avg(c).over(row))
        out = out.select("idx", *(F.when((j == 0) | (j == b.jm - 1), mean(c)).otherwise(F.col(c)).alias(c) for c in columns))
    return out


def nested_parent(idx: Column, fine: HntrSpec, coarse: HntrSpec) -> Column:
    """The cell of ``coarse`` that holds a cell of ``fine``, by integer division; the grids must nest."""
    if fine.im % coarse.im or fine.jm % coarse.jm or fine.offi != coarse.offi * (fine.im / coarse.im):
        raise ValueError("the fine grid does not nest in the coarse one")
    mi, mj = fine.im // coarse.im, fine.jm // coarse.jm
    i, j = F.pmod(idx, F.lit(fine.im)), (idx - F.pmod(idx, F.lit(fine.im))) / fine.im
    return (F.floor(j / mj).cast("long") * coarse.im + F.floor(i / mi).cast("long")).cast("long")
