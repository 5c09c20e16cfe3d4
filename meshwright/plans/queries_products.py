"""Queries of composite products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import HntrSpec
from . import topography
from .queries_grid import pairs_sql
from .registry import load, query
from .sample import A16, B8, HCDEFS, rounded

_FINE = HntrSpec(64, 32)
_PRICES = f"(SELECT p_partkey % {_FINE.size} AS p_partkey, avg(p_retailprice) AS p_retailprice FROM part GROUP BY 1)"
_RAW = f"""SELECT CAST(k AS BIGINT) AS idx, CASE WHEN (k * 7919) % 11 < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS focean, CASE WHEN (k * 7919) % 11 > 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fgice,
  coalesce(p_retailprice, 500) * 0.999983217 + k % 13 AS zicetop, coalesce(p_retailprice, 500) * 0.999983217 - 300 + k % 13 AS zsolg FROM range({_FINE.size}) t(k) LEFT JOIN {_PRICES} ON p_partkey = k"""


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, p_retailprice)``: the mean price of all parts folded onto the fine grid."""
    return load(spark, sf, "part").groupBy(F.pmod("p_partkey", F.lit(_FINE.size)).alias("id")).agg(F.avg("p_retailprice").alias("p_retailprice"))


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    u = F.pmod(k * 7919, F.lit(11))
    x = spark.range(_FINE.size).join(_prices(spark, sf), "id", "left")
    z = F.coalesce("p_retailprice", F.lit(500.0)) * 0.999983217
    return x.select(k.alias("idx"), F.when(u < 5, 1.0).otherwise(0.0).alias("focean"), F.when(u > 8, 1.0).otherwise(0.0).alias("fgice"), (z + F.pmod(k, F.lit(13))).alias("zicetop"), (z - 300 + F.pmod(k, F.lit(13))).alias("zsolg"))


_MEAN = lambda c: f"(SELECT jb * {A16.im} + ib AS idx, sum(fg * {c}) / sum(fg) AS v FROM p JOIN r ON r.idx = ja * {_FINE.im} + ia GROUP BY 1)"
_POLAR = lambda t: f"(SELECT idx, CASE WHEN idx // {A16.im} IN (0, {A16.jm - 1}) THEN avg(v) OVER (PARTITION BY idx // {A16.im}) ELSE v END AS v FROM {t})"


@query(f"""WITH r AS ({_RAW}), p AS ({pairs_sql(A16, _FINE)}), o AS {_POLAR(_MEAN('focean'))}, g AS {_POLAR(_MEAN('fgice'))},
  x AS (SELECT o.idx, o.v AS ff, g.v AS gf, o.idx // {A16.im} = 0 AS pole, o.idx % 10 = 3 AS toland FROM o JOIN g USING (idx)),
  y AS (SELECT idx, ff, CASE WHEN pole THEN 1 ELSE gf END AS gf, pole, CASE WHEN NOT pole AND NOT toland AND ff >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS focean FROM x)
  SELECT CAST(idx AS BIGINT) AS idx, focean, round(ff, 9) AS foceanf, round(gf, 9) AS fgicef, round(CASE WHEN pole THEN 1 WHEN focean = 1 THEN 0 ELSE least(1, gf / (1 - ff)) END, 9) AS fgice FROM y""")
def topoo_fractions(spark: SparkSession, sf: str) -> DataFrame:
    lakes = spark.range(A16.size).select(F.col("id").alias("idx"), (F.pmod("id", F.lit(9)) / 30.0).alias("flake"))
    to = spark.range(A16.size).filter("id % 10 = 3").select(F.col("id").alias("idx"), F.lit("land").alias("to"))
    out = topography.make_topoo(_raw(spark, sf), lakes, _FINE, A16, A16, to)
    return rounded(out.select("idx", "focean", "foceanf", "fgicef", "fgice"), "foceanf", "fgicef", "fgice", digits=9)


def _weighted(c: str, w: str) -> str:
    """SQL: the mean of a field over the cells of the ocean grid, weighted; a polar row has one value, if all of its cells have one, and 0 stands for none."""
    v = f"SELECT jb * {A16.im} + ib AS idx, sum(fg * {w} * {c}) / nullif(sum(fg * {w}), 0) AS v FROM p JOIN r ON r.idx = ja * {_FINE.im} + ia GROUP BY 1"
    return f"(SELECT idx, coalesce(CASE WHEN idx // {A16.im} IN (0, {A16.jm - 1}) THEN CASE WHEN count(v) OVER w = {A16.im} THEN avg(v) OVER w END ELSE v END, 0) AS v FROM ({v}) WINDOW w AS (PARTITION BY idx // {A16.im}))"


_FINE_AREA = f"2 * pi() / {_FINE.im} * (sin(pi() / {_FINE.jm} * (idx // {_FINE.im} + 1 - {_FINE.jm // 2})) - sin(pi() / {_FINE.jm} * (idx // {_FINE.im} - {_FINE.jm // 2})))"
_TOPOO = ("focean", "flake", "fgrnd", "fgice", "zatmo", "dzocen", "dzlake", "dzgice", "zsoldg", "zicetop", "zsglo", "zlake", "zgrnd", "zsghi", "foceanf", "fgicef", "zatmof")


@query(f"""WITH r AS (SELECT * REPLACE (fgice * 0.9371 AS fgice) FROM ({_RAW})), p AS ({pairs_sql(A16, _FINE)}), lk AS (SELECT CAST(k AS BIGINT) AS idx, CASE WHEN k // 16 IN (0, 7) THEN avg(k % 9 / 30.0::DOUBLE) OVER (PARTITION BY k // 16) ELSE k % 9 / 30.0::DOUBLE END AS v FROM range({A16.size}) t(k)),
  x AS (SELECT a.idx, a.idx // 16 AS j, a.idx % 16 AS i, a.v AS ff, g.v AS g0, zo.v AS zo, ti.v AS ti, si.v AS si, lk.v AS lk FROM {_weighted('focean', '1')} a JOIN {_weighted('fgice', '1')} g USING (idx) JOIN {_weighted('zsolg', 'focean')} zo USING (idx) JOIN {_weighted('zicetop', 'fgice')} ti USING (idx) JOIN {_weighted('zsolg', 'fgice')} si USING (idx) JOIN lk USING (idx)),
  y AS (SELECT *, CASE WHEN j > 0 AND idx % 10 <> 3 AND ff >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fo, CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE g0 END AS gf, CASE WHEN j IN (0, 7) OR j = 6 AND i IN (5, 6) THEN 0.0::DOUBLE ELSE lk END AS lake FROM x),
  y2 AS (SELECT *, CASE WHEN j = 0 THEN 1.0::DOUBLE WHEN fo = 1 THEN 0 ELSE least(greatest(coalesce(gf / nullif(1 - ff, 0), 0), 0), 1) END AS ice FROM y),
  y3 AS (SELECT *, greatest(0, least(CASE WHEN ff <> 1 THEN round(lake * (1 - fo) / (1 - ff) * 256) / 256 ELSE lake END, 1 - ice - fo)) AS fl FROM y2),
  y4 AS (SELECT *, CASE WHEN abs(1 - fo - fl - ice) < 1e-14 THEN 0 ELSE 1 - fo - fl - ice END AS fg, ti - si AS own, CASE WHEN fo = 1 THEN 0 ELSE pow(ice / (1 - fo), 0.3) END AS law, 2 * pi() / 16 * (sin(pi() / 8 * (j - 3)) - sin(pi() / 8 * (j - 4))) * ice AS ia FROM y3),
  cc AS (SELECT coalesce(sum(ia) FILTER (WHERE own = 0) * 264.7 / nullif(sum(ia * law) FILTER (WHERE own = 0), 0), 0) AS c FROM y4),
  f AS (SELECT (idx // 64) // 4 * 16 + (idx % 64) // 4 AS block, {_FINE_AREA} AS area, zicetop AS depth, focean AS ocean, fgice AS icy FROM r),
  l AS (SELECT f.*, sum(area) OVER w AS an, sum(area * depth) OVER w AS vn, sum(area) OVER (PARTITION BY block) AS sa, sum(area * depth) OVER (PARTITION BY block) AS sz, row_number() OVER w0 AS n, count(*) OVER (PARTITION BY block) AS last FROM f WHERE ocean = 0
    WINDOW w AS (PARTITION BY block ORDER BY depth, area ROWS UNBOUNDED PRECEDING), w0 AS (PARTITION BY block ORDER BY depth, area)),
  k AS (SELECT block, arg_min(depth, n) AS zl, arg_min(an, n) AS an, arg_min(vn, n) AS vn FROM l JOIN y4 ON idx = block WHERE an > sa * fl OR n = last GROUP BY 1),
  g AS (SELECT block, arg_min(depth, n) AS zg FROM l JOIN y4 ON idx = block WHERE an > sa * (fl + fg) OR n = last GROUP BY 1),
  s AS (SELECT block, any_value(sa) AS sa, any_value(sz) AS sz, min(depth) AS lo, max(depth) AS hi, sum(area * depth) FILTER (WHERE icy <> 0) / sum(area) FILTER (WHERE icy <> 0) AS zi FROM l GROUP BY block), aa AS (SELECT block, sum(area) AS aa FROM f GROUP BY block),
  z AS (SELECT y4.*, c, -zo * fo AS dzo, fo < 1 AND sa IS NOT NULL AS dry, sa, sz, zl, an, vn, zg, lo, hi, zi, aa, CASE WHEN idx % 7 = 2 THEN 1000.0::DOUBLE + idx END AS level FROM y4, cc LEFT JOIN k ON k.block = idx LEFT JOIN g ON g.block = idx LEFT JOIN s ON s.block = idx LEFT JOIN aa ON aa.block = idx),
  z2 AS (SELECT *, CASE WHEN dry THEN zl ELSE 0 END AS zlake0, CASE WHEN dry AND fl > 0 THEN greatest(zl - (vn - (an - sa * fl) * zl) / (sa * fl), 1) ELSE 0 END AS dzl, max(fo) OVER (PARTITION BY j // 2, i // 2) > 0 AND fl > 0 AS gone FROM z)
  SELECT CAST(idx AS BIGINT) AS idx, CAST(j AS INT) AS j, CAST(i AS INT) AS i, fo AS focean, round(CASE WHEN gone THEN 0 ELSE fl END, 6) AS flake, round(CASE WHEN gone THEN fg + fl ELSE fg END, 6) AS fgrnd, round(ice, 6) AS fgice, round(coalesce(level, CASE WHEN dry THEN (an * zl + sz - vn) / sa ELSE 0 END), 6) AS zatmo, round(dzo, 6) + 0 AS dzocen,
    round(CASE WHEN gone THEN 0 ELSE dzl + coalesce(level - zlake0, 0) END, 6) AS dzlake, round(CASE WHEN ice = 0 THEN 0 WHEN own <> 0 THEN own ELSE c * law END, 6) AS dzgice, round(CASE WHEN dry THEN sz / sa ELSE -dzo END, 6) AS zsoldg, round(coalesce(zi, 0), 6) AS zicetop, round(CASE WHEN dry THEN lo ELSE 0 END, 6) AS zsglo,
    round(coalesce(level, zlake0), 6) AS zlake, round(CASE WHEN dry THEN zg ELSE 0 END, 6) AS zgrnd, round(CASE WHEN dry THEN hi ELSE 0 END, 6) AS zsghi, round(ff, 6) AS foceanf, round(gf, 6) AS fgicef, round(coalesce(sz / CASE WHEN fo < 1 THEN sa ELSE aa END, 0), 6) AS zatmof FROM z2""")
def topoo_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All fields of ocean-grid topography, with overrides of the ocean mask and of lake levels."""
    k = F.col("id")
    lakes = spark.range(A16.size).select(k.alias("idx"), (F.pmod("id", F.lit(9)) / 30.0).alias("flake"))
    to = spark.range(A16.size).filter("id % 10 = 3").select(k.alias("idx"), F.lit("land").alias("to"))
    levels = spark.range(A16.size).filter("id % 7 = 2").select(k.alias("idx"), (k + 1000.0).alias("elev"))
    # ice that is no whole number of cells, or the ground would end exactly at one
    fine = _raw(spark, sf).withColumn("fgice", F.col("fgice") * 0.9371)
    return rounded(topography.make_topoo(fine, lakes, _FINE, A16, A16, to, levels), *_TOPOO)


@query(f"""WITH f AS (SELECT CAST(k AS BIGINT) AS idx, 0.0::DOUBLE AS focean, (k % 4) * 10 AS thickness, coalesce(p_retailprice, 0) AS elev, k % 5 = 0 AS greenland, k // 64 AS j, k % 64 AS i FROM range({_FINE.size}) t(k) LEFT JOIN {_PRICES} ON p_partkey = k),
  c AS (SELECT *, (j // 4) * 16 + i // 4 AS block, 2 * pi() / 64 * (sin(pi() / 32 * (j - 15)) - sin(pi() / 32 * (j - 16))) AS area FROM f WHERE j >= 16 AND NOT greenland),
  u AS (SELECT *, sum(area) OVER (PARTITION BY block ORDER BY CAST(trunc(-elev) AS INT), j, i ROWS UNBOUNDED PRECEDING) AS upto, 0.3::DOUBLE * 2 * pi() / 16 * (sin(pi() / 8 * (block // 16 - 3)) - sin(pi() / 8 * (block // 16 - 4))) AS budget FROM c),
  s AS (SELECT idx FROM u WHERE upto <= budget OR upto - area <= budget AND budget - (upto - area) >= area / 2)
  SELECT idx, CAST(thickness >= 25 OR (j - 15.5) * 5.625 > 78 OR idx IN (SELECT idx FROM s) AS DOUBLE) AS fgice FROM f""")
def global_ice_mask(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    x = spark.range(_FINE.size).join(_prices(spark, sf), "id", "left")
    fine = x.select(k.alias("idx"), F.lit(0.0).alias("focean"), (F.pmod(k, F.lit(4)) * 10).alias("thickness"), F.coalesce("p_retailprice", F.lit(0.0)).alias("elev"), (F.pmod(k, F.lit(5)) == 0).alias("greenland"))
    snow = spark.range(A16.size).select(k.alias("block"), F.lit(0.3).alias("fraction"))
    return topography.global_ice_mask(fine, snow, _FINE, A16, least_thickness=25.0)


_O = f"SELECT CAST(k AS BIGINT) AS idx, CAST(k % 3 = 0 AS DOUBLE) AS focean, CASE WHEN k % 3 = 0 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS flake, CASE WHEN k % 3 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS fgice, 17.0::DOUBLE * (k % 19) AS zatmo FROM range({A16.size}) t(k)"
_SUM = lambda c: f"(SELECT CAST(jb * {B8.im} + ib AS BIGINT) AS idx, sum(fg * {c}) / sum(fg) AS v FROM p JOIN o ON o.idx = ja * {A16.im} + ia GROUP BY 1)"


def _topoo(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    sea = F.pmod(k, F.lit(3)) == 0
    z = F.pmod(k, F.lit(19)) * 17.0
    return spark.range(A16.size).select(k.alias("idx"), sea.cast("double").alias("focean"), F.when(sea, 0.0).otherwise(0.25).alias("flake"), F.when(sea, 0.0).otherwise(0.25).alias("fgrnd"), F.when(sea, 0.0).otherwise(0.5).alias("fgice"), z.alias("zatmo"), z.alias("zlake"), (z * 2).alias("zicetop"), (z * 3 - 100).alias("zland_min"), (z * 3 + 500).alias("zland_max"), F.pmod(k, F.lit(2)).cast("int").alias("mergemask"))


def _polar_b(t: str) -> str:
    return f"(SELECT idx, CASE WHEN idx // {B8.im} IN (0, {B8.jm - 1}) THEN avg(v) OVER (PARTITION BY idx // {B8.im}) ELSE v END AS v FROM {t})"


def _topoa(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    a = F.pmod("id", F.lit(B8.size))
    m = spark.range(B8.size * 7).filter("id % 5 = 1").select(a.alias("row"), F.col("id").alias("col"), F.lit(0.5).alias("val"))
    return topography.make_topoa(_topoo(spark), m, HCDEFS, [1, 1, 1, 1, 2, 2, 2], A16, B8)


@query(f"""WITH o AS ({_O}), p AS ({pairs_sql(B8, A16)}), m AS (SELECT CAST(jb * {B8.im} + ib AS BIGINT) AS idx, min(zatmo * 3 - 100) FILTER (WHERE o.idx % 2 = 1) AS lo, max(zatmo * 3 + 500) FILTER (WHERE o.idx % 2 = 1) AS hi FROM p JOIN o ON o.idx = ja * {A16.im} + ia GROUP BY 1)
  SELECT a.idx, round(a.v, 6) AS focean, round(b.v, 6) AS fgice, round(c.v, 6) AS zatmo, round(d.v, 6) AS zicetop, round(e.v, 6) AS zland_min, round(f.v, 6) AS zland_max
  FROM {_polar_b(_SUM('focean'))} a JOIN {_polar_b(_SUM('fgice'))} b USING (idx) JOIN {_polar_b(_SUM('zatmo'))} c USING (idx) JOIN {_polar_b(f"(SELECT CAST(jb * {B8.im} + ib AS BIGINT) AS idx, coalesce(sum(fg * fgice * zatmo * 2) / nullif(sum(fg * fgice), 0), 0) AS v FROM p JOIN o ON o.idx = ja * {A16.im} + ia GROUP BY 1)")} d USING (idx)
  JOIN {_polar_b('(SELECT idx, lo AS v FROM m)')} e USING (idx) JOIN {_polar_b('(SELECT idx, hi AS v FROM m)')} f USING (idx)""")
def topoa_fields(spark: SparkSession, sf: str) -> DataFrame:
    out = _topoa(spark)[0].select("idx", "focean", "fgice", "zatmo", "zicetop", "zland_min", "zland_max")
    return rounded(out, "focean", "fgice", "zatmo", "zicetop", "zland_min", "zland_max")


@query(f"""WITH o AS ({_O}), p AS ({pairs_sql(B8, A16)}), m AS (SELECT CAST(jb * {B8.im} + ib AS BIGINT) AS idx, min(zatmo * 3 - 100) FILTER (WHERE o.idx % 2 = 1) AS lo, max(zatmo * 3 + 500) FILTER (WHERE o.idx % 2 = 1) AS hi FROM p JOIN o ON o.idx = ja * {A16.im} + ia GROUP BY 1),
  lo AS {_polar_b('(SELECT idx, lo AS v FROM m)')}, hi AS {_polar_b('(SELECT idx, hi AS v FROM m)')}, oc AS {_polar_b(_SUM('focean'))}, gi AS {_polar_b(_SUM('fgice'))}, za AS {_polar_b(_SUM('zatmo'))},
  h AS (SELECT CAST(k AS INT) AS ihc, 400.0::DOUBLE * k AS elev FROM range(7) t(k)),
  s AS (SELECT CAST(id % {B8.size} AS BIGINT) AS cell, CAST(id // {B8.size} AS INT) AS ihc, 0.5::DOUBLE AS v FROM range({B8.size * 7}) t(id) WHERE id % 5 = 1),
  q AS (SELECT ihc, sum(v) / {B8.im} AS v FROM s WHERE cell // {B8.im} = 0 GROUP BY ihc), t AS (SELECT * FROM s WHERE cell // {B8.im} > 0 UNION ALL SELECT CAST(c AS BIGINT), ihc, v FROM range({B8.im}) r(c), q),
  b AS (SELECT lo.idx AS cell, max(ihc) FILTER (WHERE elev < lo.v) AS l, max(ihc) FILTER (WHERE elev <= hi.v) AS u FROM lo JOIN hi USING (idx) CROSS JOIN h GROUP BY 1),
  x AS (SELECT b.cell, h.ihc, h.elev, t.v, coalesce(abs(oc.v - 1) > 1e-14 AND h.ihc < 4 AND h.ihc BETWEEN greatest(l - 1, 0) AND least(u + 2, 6) AND l IS NOT NULL AND t.v IS NULL, false) AS ghost FROM b CROSS JOIN h JOIN oc ON oc.idx = b.cell LEFT JOIN t ON t.cell = b.cell AND t.ihc = h.ihc)
  SELECT cell, ihc, elev, CASE WHEN ghost THEN 1e-30::DOUBLE ELSE coalesce(v, 0) END AS fhc, CASE WHEN ghost THEN 4 WHEN v IS NULL THEN 0 WHEN ihc < 4 THEN 1 ELSE 2 END AS underice FROM x
  UNION ALL SELECT gi.idx, 7, round(za.v, 6), CASE WHEN gi.v > 0 THEN 1e-30::DOUBLE ELSE 0 END, CASE WHEN gi.v > 0 THEN 3 ELSE 0 END FROM gi JOIN za USING (idx)""")
def topoa_classes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_topoa(spark)[1], "elev")
