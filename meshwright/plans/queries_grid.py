"""Queries of grids, overlaps and geometry. The SQL states the definition: all pairs of cells, intervals cut by hand."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, units
from ..functions.grids import NAMED, HntrSpec, Indexing, LonLatSpec, XYSpec, lonlat_from_hntr
from ..functions.projection import PolarStereographic
from ..operators import overlap_ll as ll
from ..operators import overlap_poly
from ..sources import gridgen
from .registry import load, query
from .sample import A16, B5, B8, COARSE, FIELD, field, rounded


def _lon(g: HntrSpec, k: str) -> str:
    return f"SELECT CAST(i AS INT) AS {k}, 360.0::DOUBLE / {g.im} * (i + {g.offi}) AS w{k}, 360.0::DOUBLE / {g.im} * (i + 1 + {g.offi}) AS e{k} FROM range({g.im}) t(i)"


def _lat(g: HntrSpec, k: str) -> str:
    s = lambda j: f"CASE WHEN {j} <= 0 THEN -1.0::DOUBLE WHEN {j} >= {g.jm} THEN 1.0::DOUBLE ELSE sin(radians(({j} - {g.jm} / 2.0::DOUBLE) * {g.dlat} / 60)) END"
    return f"SELECT CAST(j AS INT) AS {k}, {s('j')} AS s{k}, {s('(j + 1)')} AS n{k} FROM range({g.jm}) t(j)"


def pairs_sql(b: HntrSpec, a: HntrSpec) -> str:
    """(ib, jb, ia, ja, fg) of all cells that overlap, fg in (degrees of longitude) x (sine of latitude)."""
    return f"""SELECT ib, jb, ia, ja, f * g AS fg FROM (
        SELECT ib, ia, sum(greatest(0.0::DOUBLE, least(eib, eia + s) - greatest(wib, wia + s))) AS f FROM ({_lon(b, 'ib')}), ({_lon(a, 'ia')}), (VALUES (-360), (0), (360)) v(s) GROUP BY ib, ia
      ), (SELECT jb, ja, least(njb, nja) - greatest(sjb, sja) AS g FROM ({_lat(b, 'jb')}), ({_lat(a, 'ja')}))
      WHERE f > 1e-9 AND g > 1e-12"""


@query(f"SELECT ib, ia, round(f / (360.0::DOUBLE / {A16.im}), 9) AS f FROM (SELECT ib, ia, sum(greatest(0.0::DOUBLE, least(eib, eia + s) - greatest(wib, wia + s))) AS f FROM ({_lon(B5, 'ib')}), ({_lon(A16, 'ia')}), (VALUES (-360), (0), (360)) v(s) GROUP BY ib, ia) WHERE f > 1e-9")
def hntr_partition_lon(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ll.lon_overlap(spark, B5, A16), "f", digits=9)


@query(f"SELECT jb, ja, round(least(njb, nja) - greatest(sjb, sja), 9) AS g FROM ({_lat(B5, 'jb')}), ({_lat(A16, 'ja')}) WHERE least(njb, nja) - greatest(sjb, sja) > 1e-12")
def hntr_partition_lat(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ll.lat_overlap(spark, B5, A16), "g", digits=9)


def _overlap_sql(b: HntrSpec, a: HntrSpec, scaled: bool) -> str:
    area = "1" if scaled else f"2 * pi() / {b.im} * (sin(pi() / {b.jm} * (jb + 1 - {b.jm} / 2.0::DOUBLE)) - sin(pi() / {b.jm} * (jb - {b.jm} / 2.0::DOUBLE)))"
    return f"SELECT CAST(jb * {b.im} + ib AS BIGINT) AS row, CAST(ja * {a.im} + ia AS BIGINT) AS col, round(fg / sum(fg) OVER (PARTITION BY ib, jb) * {area}, 9) AS val FROM ({pairs_sql(b, a)})"


for _b, _a, _name in ((B8, A16, "nested"), (B5, A16, "offset"), (NAMED["g5x4"], COARSE, "odd_rows")):
    query(_overlap_sql(_b, _a, False), f"hntr_overlap_{_name}")(lambda spark, sf, b=_b, a=_a: rounded(ll.overlap_matrix(spark, b, a), "val", digits=9))
    query(_overlap_sql(_b, _a, True), f"hntr_scaled_matrix_{_name}")(lambda spark, sf, b=_b, a=_a: rounded(ll.overlap_matrix(spark, b, a, scaled=True), "val", digits=9))


@query(f"SELECT * FROM ({_overlap_sql(B8, A16, False)}) WHERE row IN (SELECT DISTINCT n_nationkey FROM nation)")
def hntr_overlap_included(spark: SparkSession, sf: str) -> DataFrame:
    keep = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("row")).distinct()
    return rounded(ll.overlap_matrix(spark, B8, A16, include=keep), "val", digits=9)


def regrid_sql(b: HntrSpec, a: HntrSpec, wtm: float = 1, wtb: float = 0, missing: str = "NULL", where: str = "true") -> str:
    return f"""WITH f AS ({FIELD}), p AS ({pairs_sql(b, a)})
      SELECT c.idx, coalesce(s.value, {missing}) AS value FROM (SELECT CAST(i AS BIGINT) AS idx FROM range({b.size}) t(i)) c LEFT JOIN (
        SELECT jb * {b.im} + ib AS idx, CASE WHEN sum(fg * ({wtm} * weight + {wtb})) <> 0 THEN sum(fg * ({wtm} * weight + {wtb}) * value) / sum(fg * ({wtm} * weight + {wtb})) END AS value
        FROM p JOIN f ON f.idx = ja * {a.im} + ia WHERE {where} GROUP BY 1) s USING (idx)"""


@query(f"SELECT idx, round(value, 6) AS value FROM ({regrid_sql(B8, A16)})")
def hntr_regrid_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ll.regrid(field(spark, sf), B8, A16), "value")


@query(f"SELECT idx, round(value, 6) AS value FROM ({regrid_sql(B5, A16, 2, 0.5)})")
def hntr_regrid_affine_weight(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ll.regrid(field(spark, sf), B5, A16, wtm=2.0, wtb=0.5), "value")


@query(f"SELECT idx, round(value, 6) AS value FROM ({regrid_sql(B8, A16, missing='-999.0::DOUBLE', where='f.idx % 16 < 5')})")
def hntr_regrid_missing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ll.regrid(field(spark, sf).filter("idx % 16 < 5"), B8, A16, missing=-999.0), "value")


@query(f"""WITH r AS ({regrid_sql(B8, A16, where='f.idx > 3')}), m AS (SELECT idx // {B8.im} AS j, CASE WHEN count(value) = {B8.im} THEN avg(value) END AS m FROM r GROUP BY 1)
  SELECT r.idx, round(CASE WHEN j IN (0, {B8.jm - 1}) THEN m ELSE value END, 6) AS value FROM r JOIN m ON r.idx // {B8.im} = j""")
def hntr_mean_polar(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ll.regrid(field(spark, sf).filter("idx > 3"), B8, A16, mean_polar=True), "value")


@query(f"""WITH f AS ({FIELD}), p AS ({pairs_sql(B8, A16)}), r AS ({regrid_sql(B8, A16, 0, 1)}), c AS (SELECT jb * {B8.im} + ib AS idx, sum(fg) AS area FROM p GROUP BY 1)
  SELECT round(sum(value * area), 4) AS target, round((SELECT sum(fg * value) FROM p JOIN f ON f.idx = ja * {A16.im} + ia), 4) AS source FROM r JOIN c USING (idx)""")
def hntr_conservation(spark: SparkSession, sf: str) -> DataFrame:
    """The integral of a field before and after regridding, with equal weights; in degrees times sine."""
    f = field(spark, sf).withColumn("weight", F.lit(1.0))
    lon = lambda df, g: df.withColumn("area", 360.0 / g.im * (F.sin((F.expr(f"idx div {g.im}") + 1 - g.jm / 2) * math.pi / g.jm) - F.sin((F.expr(f"idx div {g.im}") - g.jm / 2) * math.pi / g.jm)))
    b = lon(ll.regrid(f, B8, A16), B8).agg(F.sum(F.col("value") * F.col("area")).alias("target"))
    a = lon(f, A16).agg(F.sum(F.col("value") * F.col("area")).alias("source"))
    return rounded(b.crossJoin(a), "target", "source", digits=4)


@query(f"SELECT l_partkey % {A16.size} AS idx, CAST((l_partkey % {A16.size} // {A16.im}) // 2 * {B8.im} + (l_partkey % {A16.im}) // 2 AS BIGINT) AS parent, count(*) AS n FROM lineitem GROUP BY 1, 2")
def nested_parent(spark: SparkSession, sf: str) -> DataFrame:
    idx = F.pmod("l_partkey", F.lit(A16.size))
    return load(spark, sf, "lineitem").groupBy(idx.alias("idx"), ll.nested_parent(idx, A16, B8).alias("parent")).agg(F.count("*").alias("n"))


@query("""SELECT name, CAST(j AS BIGINT) AS j, round(sin(pi() / jm * (j + 1 - jm / 2.0::DOUBLE)) * 2 * pi() / im - sin(pi() / jm * (j - jm / 2.0::DOUBLE)) * 2 * pi() / im, 12) AS area
  FROM (VALUES ('g5x4', 72, 45), ('g2hx2', 144, 90)) g(name, im, jm), range(90) t(j) WHERE j < jm""")
def row_areas(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(n, j, NAMED[n].row_area(j)) for n in ("g5x4", "g2hx2") for j in range(NAMED[n].jm)]
    return rounded(spark.createDataFrame(rows, "name string, j long, area double"), "area", digits=12)


_LL = LonLatSpec(tuple(-180.0 + 45 * k for k in range(9)), (-60.0, -30.0, 0.0, 30.0, 60.0), True, True)


@query("""WITH c AS (SELECT i, j, -180.0::DOUBLE + 45 * i AS lon0, -180.0::DOUBLE + 45 * (i + 1) AS lon1, -90.0::DOUBLE + 30 * j AS lat0, -90.0::DOUBLE + 30 * (j + 1) AS lat1 FROM range(8) a(i), range(6) b(j) WHERE j BETWEEN 1 AND 4 OR i = 0)
  SELECT CAST(j * 8 + i AS BIGINT) AS cell_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j,
    round(CASE WHEN j IN (0, 5) THEN 2 * pi() * (1 - cos(radians(30))) ELSE radians(lon1 - lon0) * (sin(radians(lat1)) - sin(radians(lat0))) END, 9) AS native_area,
    CASE WHEN j IN (0, 5) THEN 0.0::DOUBLE ELSE (lon0 + lon1) / 2 END AS cx, CASE WHEN j = 0 THEN -90.0::DOUBLE WHEN j = 5 THEN 90.0::DOUBLE ELSE (lat0 + lat1) / 2 END AS cy,
    CAST(CASE WHEN j IN (0, 5) THEN 8 ELSE 4 END AS BIGINT) AS n_vertices FROM c""")
def lonlat_grid(spark: SparkSession, sf: str) -> DataFrame:
    cells = gridgen.lonlat_cells(spark, _LL).withColumn("n_vertices", F.size("ring").cast("long")).drop("ring")
    return rounded(cells, "native_area", digits=9)


@query("""WITH c AS (SELECT i, j, -180.0::DOUBLE + 22.5 * i AS w, -90.0::DOUBLE + 22.5 * j AS s FROM range(16) a(i), range(8) b(j))
  SELECT CAST(j * 16 + i AS BIGINT) AS cell_id, round(radians(22.5) * (sin(radians(s + 22.5)) - sin(radians(s))), 9) AS native_area FROM c
  WHERE w < -10 AND w + 22.5 > -74 AND s < 87.5 AND s + 22.5 > 59 OR s <= -60""")
def lonlat_clip_sheets(spark: SparkSession, sf: str) -> DataFrame:
    cells = gridgen.lonlat_cells(spark, lonlat_from_hntr(A16), geometry.clip_sheets(geometry.GREENLAND | geometry.ANTARCTICA), rings=False)
    return rounded(cells.select("cell_id", "native_area"), "native_area", digits=9)


@query("""WITH c AS (SELECT i, j, -180.0::DOUBLE + 22.5 * i AS w, -90.0::DOUBLE + 22.5 * j AS s FROM range(16) a(i), range(8) b(j)),
  k AS (SELECT j * 16 + i AS cell_id, w + 22.5 * u AS lon, s + 22.5 * v AS lat FROM c, range(2) a(u), range(2) b(v))
  SELECT DISTINCT CAST(cell_id AS BIGINT) AS cell_id FROM k
  WHERE degrees(2 * asin(sqrt(pow(sin(radians(lat - 72) / 2), 2) + cos(radians(lat)) * cos(radians(72)) * pow(sin(radians(lon + 40) / 2), 2)))) <= 25""")
def lonlat_clip_azimuthal(spark: SparkSession, sf: str) -> DataFrame:
    return gridgen.lonlat_cells(spark, lonlat_from_hntr(A16), geometry.clip_azimuthal(-40, 72, 25), rings=False).select("cell_id")


@query("""SELECT CAST(j * 7 + i AS BIGINT) AS cell_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, 8.0::DOUBLE AS native_area, -10.0::DOUBLE + 4 * i + 2 AS cx, 3.0::DOUBLE + 2 * j + 1 AS cy FROM range(7) a(i), range(5) b(j)""")
def xy_grid(spark: SparkSession, sf: str) -> DataFrame:
    return gridgen.xy_cells(spark, XYSpec.between(-10, 18, 4.1, 3, 13, 2)).drop("ring")


_XA, _XI = XYSpec.between(0, 12, 4, 0, 9, 3), XYSpec.between(1, 11, 1.25, -1, 8, 1.5)


@query("""SELECT * FROM (SELECT CAST(ja * 3 + ia AS BIGINT) AS a_id, CAST(ji * 8 + ii AS BIGINT) AS i_id,
    round((least(4 * (ia + 1.0::DOUBLE), 1 + 1.25 * (ii + 1)) - greatest(4.0::DOUBLE * ia, 1 + 1.25 * ii)) * (least(3.0::DOUBLE * (ja + 1), -1 + 1.5 * (ji + 1)) - greatest(3.0::DOUBLE * ja, -1 + 1.5 * ji)), 9) AS area
  FROM range(3) a(ia), range(3) b(ja), range(8) c(ii), range(6) d(ji)
  WHERE least(4 * (ia + 1), 1 + 1.25 * (ii + 1)) > greatest(4 * ia, 1 + 1.25 * ii) AND least(3 * (ja + 1), -1 + 1.5 * (ji + 1)) > greatest(3 * ja, -1 + 1.5 * ji)) WHERE area > 0""")
def exchange_grid(spark: SparkSession, sf: str) -> DataFrame:
    x = overlap_poly.exchange_grid(gridgen.xy_cells(spark, _XA), gridgen.xy_cells(spark, _XI))
    return rounded(x, "area", digits=9)


@query("""SELECT a_id, round(sum(area), 9) AS area, count(*) AS n FROM (SELECT ja * 3 + ia AS a_id, (least(4 * (ia + 1.0::DOUBLE), 1 + 1.25 * (ii + 1)) - greatest(4.0::DOUBLE * ia, 1 + 1.25 * ii)) * (least(3.0::DOUBLE * (ja + 1), -1 + 1.5 * (ji + 1)) - greatest(3.0::DOUBLE * ja, -1 + 1.5 * ji)) AS area
  FROM range(3) a(ia), range(3) b(ja), range(8) c(ii), range(6) d(ji)
  WHERE least(4 * (ia + 1), 1 + 1.25 * (ii + 1)) > greatest(4 * ia, 1 + 1.25 * ii) AND least(3 * (ja + 1), -1 + 1.5 * (ji + 1)) > greatest(3 * ja, -1 + 1.5 * ji)) WHERE a_id % 2 = 0 GROUP BY a_id""")
def exchange_filtered(spark: SparkSession, sf: str) -> DataFrame:
    i = gridgen.xy_cells(spark, _XI)
    x = overlap_poly.exchange_grid(gridgen.xy_cells(spark, _XA), i)
    x, _ = overlap_poly.filter_exchange(x, i, gridgen.xy_cells(spark, _XA).filter("cell_id % 2 = 0").select(F.col("cell_id").alias("a_id")))
    return rounded(x.groupBy("a_id").agg(F.sum("area").alias("area"), F.count("*").alias("n")), "area", digits=9)


@query("""WITH p AS (SELECT DISTINCT x, y FROM (SELECT -10.0::DOUBLE + 4 * (i + u) AS x, 3.0::DOUBLE + 2 * (j + v) AS y FROM range(7) a(i), range(5) b(j), range(2) c(u), range(2) d(v)))
  SELECT CAST(row_number() OVER (ORDER BY x, y) - 1 AS BIGINT) AS vid, x, y FROM p""")
def vertex_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return gridgen.number_vertices(gridgen.xy_cells(spark, XYSpec.between(-10, 18, 4, 3, 13, 2)))[1]


@query("""SELECT s_suppkey, round((3 + k) * (4 + m) / 2.0::DOUBLE, 6) AS area, round((3 + k) / 3.0::DOUBLE + m, 6) AS cx, round((4 + m) / 3.0::DOUBLE + k, 6) AS cy FROM (SELECT s_suppkey, s_suppkey % 5 AS k, s_nationkey % 3 AS m FROM supplier)""")
def shoelace_centroid(spark: SparkSession, sf: str) -> DataFrame:
    k, m = F.pmod("s_suppkey", F.lit(5)).cast("double"), F.pmod("s_nationkey", F.lit(3)).cast("double")
    v = lambda x, y: F.struct(F.lit(None).cast("long").alias("vid"), x.alias("x"), y.alias("y"))
    t = load(spark, sf, "supplier").select("s_suppkey", F.array(v(m, k), v(m + 3 + k, k), v(m, k + 4 + m)).alias("ring"))
    cx, cy = geometry.centroid(F.col("ring"))
    return rounded(t.select("s_suppkey", geometry.shoelace(F.col("ring")).alias("area"), cx.alias("cx"), cy.alias("cy")), "area", "cx", "cy")


@query("SELECT s_suppkey, round(degrees(2 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(d) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(l) / 2), 2))))), 6) AS angle, lon FROM (SELECT s_suppkey, CAST(s_suppkey % 90 AS DOUBLE) AS a, CAST(-(s_suppkey % 60) AS DOUBLE) AS b, -(s_suppkey % 60) - s_suppkey % 90 AS d, s_suppkey % 170 AS l, ((s_suppkey * 37.0::DOUBLE + 180) % 360) - 180 AS lon FROM supplier)")
def haversine_normalise(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    a, b, lon = F.pmod(k, F.lit(90)).cast("double"), -F.pmod(k, F.lit(60)).cast("double"), F.pmod(k, F.lit(170)).cast("double")
    out = load(spark, sf, "supplier").select("s_suppkey", geometry.haversine(F.lit(0.0), a, lon, b).alias("angle"), geometry.lon_normal(k * 37.0).alias("lon"))
    return rounded(out, "angle")


@query("""SELECT s_suppkey, round(rho * sin(radians(lon + 39)), 3) AS x, round(-rho * cos(radians(lon + 39)), 3) AS y FROM (
  SELECT s_suppkey, lon, 6378137.0::DOUBLE * cos(radians(71)) / sqrt(1 - e * e * pow(sin(radians(71)), 2)) * t / tc AS rho FROM (
    SELECT *, tan(pi() / 4 - radians(lat) / 2) * pow((1 + e * sin(radians(lat))) / (1 - e * sin(radians(lat))), e / 2) AS t, tan(pi() / 4 - radians(71) / 2) * pow((1 + e * sin(radians(71))) / (1 - e * sin(radians(71))), e / 2) AS tc FROM (
      SELECT s_suppkey, -74.0::DOUBLE + s_suppkey % 60 AS lon, 59.5::DOUBLE + s_suppkey % 28 AS lat, sqrt(2 / 298.257223563 - 1 / 298.257223563 / 298.257223563) AS e FROM supplier)))""")
def polar_stereographic(spark: SparkSession, sf: str) -> DataFrame:
    p = PolarStereographic(-39.0, 90.0, 71.0)
    k = F.col("s_suppkey")
    x, y = p.forward(F.pmod(k, F.lit(60)) - 74.0, F.pmod(k, F.lit(28)) + 59.5)
    return rounded(load(spark, sf, "supplier").select("s_suppkey", x.alias("x"), y.alias("y")), "x", "y", digits=3)


@query("SELECT s_suppkey, CAST(s_suppkey % 12 AS BIGINT) AS i, CAST(s_suppkey // 12 % 9 + 1 AS BIGINT) AS j, CAST(s_suppkey % 108 AS BIGINT) AS idx FROM supplier")
def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    ix = Indexing(("i", "j"), (0, 1), (12, 9), (1, 0))
    i, j = ix.tuple_columns(F.pmod("s_suppkey", F.lit(ix.size)))
    t = load(spark, sf, "supplier").select("s_suppkey", i.alias("i"), j.alias("j"))
    return t.withColumn("idx", ix.index_column(F.col("i"), F.col("j")))


@query("SELECT event_id, strftime(make_date(1951, 1, 1) + CAST((event_id * 7919 % 31536000) // 86400 AS INTEGER), '%Y%m%d') AS sdate FROM events")
def date_365(spark: SparkSession, sf: str) -> DataFrame:
    s = F.lit(31536000.0) + F.pmod(F.col("event_id") * 7919, F.lit(31536000))
    return load(spark, sf, "events").select("event_id", units.date_365_column(s).alias("sdate"))
