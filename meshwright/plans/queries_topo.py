"""Queries of topography, merging, ocean masks and coupling, with their definitions in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import HntrSpec
from ..operators import coo, merging, ocean, topo
from ..operators.matrices import SPECS
from ..sources import fortran
from ..sources.tables import shared_path
from ..streaming import contract, coupling
from .queries_grid import pairs_sql
from .queries_matrix import FACTS
from .registry import load, query
from .sample import A16, B8, EXCHANGE, FIELD, HCDEFS, N_A, exchange, field, ice_mask, rounded

# -- windows --------------------------------------------------------------------------------------------------------
_CELLS = "SELECT p_partkey % 40 AS block, CAST(p_partkey // 40 AS INT) AS j, CAST(p_partkey % 7 AS INT) AS i, p_retailprice AS elev, 1.0::DOUBLE + p_size % 4 AS area FROM part"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, sf, "part").select(F.pmod(k, F.lit(40)).alias("block"), F.floor(k / 40).cast("int").alias("j"), F.pmod(k, F.lit(7)).cast("int").alias("i"), F.col("p_retailprice").alias("elev"), (F.pmod("p_size", F.lit(4)) + 1.0).alias("area"))


@query(f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY CAST(trunc(-elev) AS INT), j, i) AS n FROM ({_CELLS})),
  g AS (SELECT block, 0 AS n, 3.0::DOUBLE * block AS remain, false AS filled, NULL::INT AS j, NULL::INT AS i, false AS done FROM range(40) t(block)
    UNION ALL SELECT c.block, g.n + 1, CASE WHEN c.area <= g.remain THEN g.remain - c.area ELSE g.remain END, c.area <= g.remain OR g.remain >= c.area / 2, c.j, c.i, c.area > g.remain
    FROM g JOIN c ON c.block = g.block AND c.n = g.n + 1 WHERE NOT g.done AND g.block > 0)
  SELECT c.block, c.j, c.i, coalesce(g.filled, false) AS filled FROM c LEFT JOIN g ON g.block = c.block AND g.n = c.n""")
def budget_fill(spark: SparkSession, sf: str) -> DataFrame:
    budgets = spark.range(40).select(F.col("id").alias("block"), (F.col("id") * 3.0).alias("budget"))
    return topo.budget_fill(_cells(spark, sf), budgets).select("block", "j", "i", "filled")


_FINE = "SELECT p_partkey % 25 AS block, 1.0::DOUBLE + p_size % 4 AS area, p_retailprice AS depth, CAST(p_size % 5 = 0 AS INT) AS ocean, CAST(p_size % 3 = 0 AS INT) AS ice FROM part"


@query(f"""WITH f AS ({_FINE}), q AS (SELECT CAST(b AS BIGINT) AS block, CASE WHEN b % 6 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS focean, CASE WHEN b % 6 = 0 OR b % 4 = 1 THEN 0.0::DOUBLE ELSE b * 0.011::DOUBLE END AS flake, CASE WHEN b % 6 = 0 THEN 0.0::DOUBLE ELSE b * 0.0171::DOUBLE END AS fgrnd FROM range(25) t(b)),
  l AS (SELECT *, sum(area) OVER w AS an, sum(area * depth) OVER w AS vn, sum(area) OVER (PARTITION BY block) AS sa, sum(area * depth) OVER (PARTITION BY block) AS sz, row_number() OVER w0 AS n, count(*) OVER (PARTITION BY block) AS last FROM f WHERE ocean = 0
    WINDOW w AS (PARTITION BY block ORDER BY depth, area ROWS UNBOUNDED PRECEDING), w0 AS (PARTITION BY block ORDER BY depth, area)),
  k AS (SELECT l.block, arg_min(depth, n) AS zlake, arg_min(an, n) AS an, arg_min(vn, n) AS vn FROM l JOIN q USING (block) WHERE an > sa * flake OR n = last GROUP BY 1),
  g AS (SELECT l.block, arg_min(depth, n) AS zgrnd FROM l JOIN q USING (block) WHERE an > sa * (flake + fgrnd) OR n = last GROUP BY 1),
  s AS (SELECT block, any_value(sa) AS sa, any_value(sz) AS sz, min(depth) AS lo, max(depth) AS hi, sum(area * depth) FILTER (WHERE ice = 1) / sum(area) FILTER (WHERE ice = 1) AS zi FROM l GROUP BY block),
  a AS (SELECT block, sum(area) AS aa FROM f GROUP BY block)
  SELECT q.block, round(sz / CASE WHEN focean < 1 THEN sa ELSE aa END, 6) AS zatmof, round(coalesce(zi, 0), 6) AS zicetop, CASE WHEN focean < 1 THEN round(sz / sa, 6) END AS zsoldg,
    CASE WHEN focean < 1 THEN lo END AS zsglo, CASE WHEN focean < 1 THEN hi END AS zsghi, CASE WHEN focean < 1 THEN zlake END AS zlake,
    CASE WHEN focean < 1 THEN CASE WHEN flake > 0 THEN round(greatest(zlake - (vn - (an - sa * flake) * zlake) / (sa * flake), 1), 6) ELSE 0 END END AS dzlake,
    CASE WHEN focean < 1 THEN round((an * zlake + sz - vn) / sa, 6) END AS zatmo, CASE WHEN focean < 1 THEN zgrnd END AS zgrnd
  FROM q JOIN a USING (block) JOIN s USING (block) JOIN k USING (block) JOIN g USING (block)""")
def lake_level(spark: SparkSession, sf: str) -> DataFrame:
    fine = load(spark, sf, "part").select(F.pmod("p_partkey", F.lit(25)).alias("block"), (F.pmod("p_size", F.lit(4)) + 1.0).alias("area"), F.col("p_retailprice").alias("depth"), (F.pmod("p_size", F.lit(5)) == 0).cast("int").alias("ocean"), (F.pmod("p_size", F.lit(3)) == 0).cast("int").alias("ice"))
    b = F.col("id")
    sea = F.pmod(b, F.lit(6)) == 0
    q = spark.range(25).select(b.alias("block"), F.when(sea, 1.0).otherwise(0.0).alias("focean"), F.when(sea | (F.pmod(b, F.lit(4)) == 1), 0.0).otherwise(b * 0.011).alias("flake"), F.when(sea, 0.0).otherwise(b * 0.0171).alias("fgrnd"))
    return rounded(topo.z_statistics(fine, q), "zatmof", "zicetop", "zsoldg", "dzlake", "zatmo")


@query("""WITH c AS (SELECT s_suppkey AS cell, CASE WHEN s_suppkey % 7 = 0 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS focean, s_suppkey * 13.0::DOUBLE % 1500 - 100 AS zmin, s_suppkey * 13.0::DOUBLE % 1500 + 300 AS zmax FROM supplier),
  h AS (SELECT CAST(k AS INT) AS ihc, 400.0::DOUBLE * k AS elev FROM range(7) t(k)), f AS (SELECT s_suppkey AS cell, CAST(s_suppkey % 7 AS INT) AS ihc, 0.5::DOUBLE AS fhc FROM supplier),
  b AS (SELECT cell, max(ihc) FILTER (WHERE elev < zmin) AS lo, max(ihc) FILTER (WHERE elev <= zmax) AS hi FROM c, h GROUP BY cell),
  x AS (SELECT c.cell, h.ihc, h.elev, f.fhc, coalesce(focean <> 1 AND h.ihc BETWEEN greatest(lo - 1, 0) AND least(hi + 2, 6) AND f.fhc IS NULL AND lo IS NOT NULL, false) AS ghost FROM c CROSS JOIN h JOIN b ON b.cell = c.cell LEFT JOIN f ON f.cell = c.cell AND f.ihc = h.ihc)
  SELECT cell, ihc, elev, CASE WHEN ghost THEN 1e-30::DOUBLE ELSE coalesce(fhc, 0) END AS fhc, CASE WHEN ghost THEN 4 WHEN fhc IS NOT NULL THEN 1 ELSE 0 END AS underice FROM x""")
def ghost_ec(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    z = F.pmod(k * 13.0, F.lit(1500.0))
    s = load(spark, sf, "supplier")
    cells = s.select(k.alias("cell"), F.when(k % 7 == 0, 1.0).otherwise(0.25).alias("focean"), (z - 100).alias("zland_min"), (z + 300).alias("zland_max"))
    fhc = s.select(k.alias("cell"), F.pmod(k, F.lit(7)).cast("int").alias("ihc"), F.lit(0.5).alias("fhc"), F.lit(topo.UI_LOCALICE).alias("underice"))
    return topo.ghost_classes(cells, fhc, HCDEFS)


@query(f"WITH f AS ({FIELD}), m AS (SELECT idx // 16 AS j, avg(value) AS m FROM f GROUP BY 1) SELECT idx, round(CASE WHEN j IN (0, 7) THEN m ELSE value END, 6) AS value FROM f JOIN m ON idx // 16 = j")
def merge_poles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(topo.merge_poles(field(spark, sf).select("idx", "value"), 16, 8), "value")


_GRID = "SELECT CAST(c_custkey // 30 AS INT) AS j, CAST(c_custkey % 30 AS INT) AS i, c_nationkey, c_acctbal FROM customer"


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, sf, "customer").select(F.floor(k / 30).cast("int").alias("j"), F.pmod(k, F.lit(30)).cast("int").alias("i"), "c_nationkey", "c_acctbal")


@query(f"""WITH c AS (SELECT j, i, CASE WHEN c_nationkey % 5 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS focean, CASE WHEN c_nationkey % 3 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS flake FROM ({_GRID})), d AS (SELECT *, 1 - focean - flake AS fgrnd FROM c)
  SELECT d.j, d.i, d.focean, CASE WHEN e.wet AND d.flake > 0 THEN 0.0::DOUBLE ELSE d.flake END AS flake, CASE WHEN e.wet AND d.flake > 0 THEN d.fgrnd + d.flake ELSE d.fgrnd END AS fgrnd
  FROM d JOIN (SELECT j // 2 AS bj, i // 2 AS bi, max(focean) > 0 AS wet FROM d GROUP BY 1, 2) e ON d.j // 2 = bj AND d.i // 2 = bi""")
def block2x2_any(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_nationkey")
    c = _grid(spark, sf).select("j", "i", F.when(n % 5 == 0, 0.5).otherwise(0.0).alias("focean"), F.when(n % 3 == 0, 0.25).otherwise(0.0).alias("flake"))
    return topo.lake_near_ocean(c.withColumn("fgrnd", 1 - F.col("focean") - F.col("flake")))


_OCEAN = f"SELECT j, i, CASE WHEN c_nationkey % 6 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m, CASE WHEN c_nationkey % 12 = 0 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS p FROM ({_GRID})"


@query(f"""WITH o AS ({_OCEAN}) SELECT o.j, o.i, CASE WHEN c.j IS NOT NULL THEN 0.0::DOUBLE ELSE o.m END AS focean_m, CASE WHEN c.j IS NOT NULL THEN 0.5::DOUBLE END AS fgice_m, CASE WHEN c.j IS NOT NULL THEN 0.25::DOUBLE END AS fgrnd_m, CASE WHEN c.j IS NOT NULL THEN 40.0::DOUBLE END AS zatmo_m, c.j IS NOT NULL AS changed
  FROM o LEFT JOIN (SELECT o.j, o.i FROM o JOIN o n ON abs(o.j - n.j) + abs(o.i - n.i) = 1 WHERE o.m = 1 AND o.p <> 1 AND n.m = 0 AND o.i BETWEEN 1 AND 28 AND o.j BETWEEN 1 AND 47 GROUP BY 1, 2 HAVING count(*) = 4) c ON c.j = o.j AND c.i = o.i""")
def neighbour_ocean(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_nationkey")
    c = _grid(spark, sf).select("j", "i", F.when(n % 6 == 0, 1.0).otherwise(0.0).alias("focean_m"), F.when(n % 12 == 0, 1.0).otherwise(0.75).alias("focean_p"), F.lit(0.125).alias("fgice_p"), F.lit(10.0).alias("zatmo_p"), F.lit(0.25).alias("flake_m"))
    return topo.neighbour_ocean(c, 30, 49).select("j", "i", "focean_m", "fgice_m", "fgrnd_m", "zatmo_m", "changed")


@query("SELECT p_partkey AS idx, n, CAST(floor(coalesce(sum(n) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 500.0) AS BIGINT) AS chunk FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS n FROM part)")
def chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    return merging.plan_chunks(load(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("long").alias("n")), 500)


# -- merging ----------------------------------------------------------------------------------------------------------
_ECS = f"SELECT CAST(ihc * {N_A} + a_id AS BIGINT) AS row, i_id AS col, area AS val FROM (SELECT i_id % 7 AS ihc, * FROM ({EXCHANGE}))"


@query(f"WITH h AS (SELECT ihc, dense_rank() OVER (ORDER BY elev) - 1 AS new FROM (VALUES (0, 800), (1, 0), (2, 400), (3, 800), (4, 0), (5, 1200), (6, 400)) t(ihc, elev)) SELECT CAST(new * {N_A} + row % {N_A} AS BIGINT) AS row, col, sum(val) AS val FROM ({_ECS}) JOIN h ON ihc = row // {N_A} GROUP BY 1, 2")
def squash_ec(spark: SparkSession, sf: str) -> DataFrame:
    m = exchange(spark, sf).select((F.pmod("i_id", F.lit(7)) * N_A + F.col("a_id")).alias("row"), F.col("i_id").alias("col"), F.col("area").alias("val"))
    hc = spark.createDataFrame([(k, float(e), 1) for k, e in enumerate((800, 0, 400, 800, 0, 1200, 400))], "ihc int, elev double, underice int")
    return merging.squash_classes(m, hc, N_A)[0]


@query("SELECT ihc, elev, underice FROM (SELECT CAST(dense_rank() OVER (ORDER BY elev) - 1 AS INT) AS ihc, elev, min(underice) OVER (PARTITION BY elev) AS underice FROM (VALUES (800.0::DOUBLE, 1), (0.0::DOUBLE, 2), (800.0::DOUBLE, 2)) t(elev, underice)) GROUP BY ALL")
def squash_ec_levels(spark: SparkSession, sf: str) -> DataFrame:
    hc = spark.createDataFrame([(0, 800.0, 1), (1, 0.0, 2), (2, 800.0, 2)], "ihc int, elev double, underice int")
    m = spark.createDataFrame([(0, 0, 1.0)], "row long, col long, val double")
    return merging.squash_classes(m, hc, 10)[1]


@query("SELECT row, col, round(val / w, 9) AS val FROM (SELECT l_suppkey AS row, l_partkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2) JOIN (SELECT l_suppkey AS row, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1) USING (row)")
def combine_chunks(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").withColumn("chunk", F.pmod("l_orderkey", F.lit(5)))
    chunks = li.groupBy("chunk", F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("val"))
    w = li.groupBy("chunk", F.col("l_suppkey").alias("idx")).agg(F.count("*").cast("double").alias("w"))
    return rounded(merging.combine_chunks(chunks, w, scale=True)[0], "val", digits=9)


@query(f"SELECT row, min(p_retailprice) FILTER (WHERE p_size % 2 = 1) AS zmin, max(p_retailprice * 2) FILTER (WHERE p_size % 2 = 1) AS zmax, CAST(max(p_size % 2) AS INT) AS mask FROM (SELECT a_id AS row, i_id AS col FROM ({EXCHANGE})) JOIN part ON p_partkey = col GROUP BY row")
def minmax_mask(spark: SparkSession, sf: str) -> DataFrame:
    m = exchange(spark, sf).select(F.col("a_id").alias("row"), F.col("i_id").alias("col"), F.col("area").alias("val"))
    cells = load(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("zmin"), (F.col("p_retailprice") * 2).alias("zmax"), F.pmod("p_size", F.lit(2)).cast("int").alias("mask"))
    return topo.min_max_mask(m, cells)


_FR = "SELECT c_custkey AS idx, c_nationkey / 50.0::DOUBLE AS focean, c_nationkey / 90.0::DOUBLE AS flake, (25 - c_nationkey) / 60.0::DOUBLE AS fgice FROM customer"


@query(f"""WITH q AS (SELECT idx, focean, least(round(least(greatest(flake, 0), 1) * 256) / 256, 1 - focean) AS flake, round(least(greatest(fgice, 0), 1) * 256) / 256 AS fgice FROM ({_FR})), r AS (SELECT idx, focean, flake, least(fgice, 1 - focean - flake) AS fgice FROM q)
  SELECT idx, round(focean, 9) AS focean, round(flake, 9) AS flake, round(fgice, 9) AS fgice, round(CASE WHEN abs(1 - focean - flake - fgice) < 1e-14 THEN 0 ELSE 1 - focean - flake - fgice END, 9) AS fgrnd FROM r""")
def land_fractions(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_nationkey")
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), (n / 50.0).alias("focean"), (n / 90.0).alias("flake"), ((25 - n) / 60.0).alias("fgice"))
    return rounded(topo.land_fractions(c), "focean", "flake", "fgice", "fgrnd", digits=9)


@query("""WITH c AS (SELECT c_custkey AS idx, 1.0::DOUBLE + c_nationkey AS area, (c_nationkey % 4) / 4.0::DOUBLE AS fgice, greatest(c_acctbal, 0) AS rgice FROM customer), l AS (SELECT *, CASE WHEN fgice > 0 AND rgice > 0 THEN pow(rgice, 0.3) ELSE 0 END AS law FROM c)
  SELECT idx, round(law * (SELECT sum(area * fgice) * 264.7 / sum(area * fgice * law) FROM l), 6) AS thick FROM l""")
def ice_thickness(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_nationkey")
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), (n + 1.0).alias("area"), (F.pmod(n, F.lit(4)) / 4.0).alias("fgice"), F.greatest("c_acctbal", F.lit(0.0)).alias("rgice"))
    return rounded(topo.ice_thickness(c).select("idx", "thick"), "thick")


@query("""WITH c AS (SELECT s_suppkey AS idx, 50.0::DOUBLE + s_suppkey % 9 AS area, (s_suppkey % 3) / 2.0::DOUBLE AS fo FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT s_suppkey + 1000000000 FROM supplier)),
  d AS (SELECT l_suppkey AS idx, sum(l_quantity) / 200.0 AS cont, sum(l_tax) * 20 AS ice, sum(l_discount) * 300 AS zatmo, sum(l_discount) * 700 AS ztop FROM lineitem GROUP BY 1),
  x AS (SELECT c.idx, area, CASE WHEN fo > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fm, CASE WHEN cont IS NULL THEN fo ELSE fo - cont / area END AS op, coalesce(ice, 0) / area AS di, CASE WHEN cont IS NULL THEN 5.0::DOUBLE ELSE 5 + zatmo / area END AS zp, coalesce(ztop, 0) AS dz, cont IS NOT NULL AS added FROM c LEFT JOIN d USING (idx)),
  y AS (SELECT *, 0.1 + di AS ip, added AND op < 0.5 AND fm = 1 AS t FROM x)
  SELECT idx, round(op, 6) AS focean_p, round(ip, 6) AS fgice_p, round(zp, 6) AS zatmo_p, round(CASE WHEN added THEN (90 * 0.1 + dz / area * di) / ip ELSE 90 END, 6) AS zicetop, CASE WHEN t THEN 0.0::DOUBLE ELSE fm END AS focean_m, round(CASE WHEN t THEN ip / (1 - op) ELSE 0 END, 6) AS fgice_m, round(CASE WHEN t THEN zp / (1 - op) ELSE 0 END, 6) AS zatmo_m, round(CASE WHEN t THEN 1 - ip / (1 - op) - 0.05 ELSE 0 END, 6) AS fgrnd_m, CAST(added AS INT) AS mergemask FROM y""")
def merge_sheets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    fo = F.pmod(k, F.lit(3)) / 2.0
    lit = lambda v: F.lit(float(v))
    keys = load(spark, sf, "supplier").select("s_suppkey")
    keys = keys.union(keys.select(k + 1000000000))  # as many cells without any ice sheet
    cells = keys.select(k.alias("idx"), (50.0 + F.pmod(k, F.lit(9))).alias("area"), fo.alias("focean_p"), lit(0.1).alias("fgice_p"), lit(5).alias("zatmo_p"), lit(90).alias("zicetop"), F.when(fo > 0, 1.0).otherwise(0.0).alias("focean_m"), lit(0.05).alias("flake_m"), lit(0).alias("fgrnd_m"), lit(0).alias("fgice_m"), lit(0).alias("zatmo_m"))
    li = load(spark, sf, "lineitem")
    sheets = li.groupBy(F.col("l_suppkey").alias("idx"), F.pmod("l_orderkey", F.lit(2)).alias("sheet")).agg((F.sum("l_quantity") / 200).alias("da_cont"), (F.sum("l_tax") * 20).alias("da_ice"), (F.sum("l_discount") * 300).alias("da_zatmo"), (F.sum("l_discount") * 700).alias("da_zicetop"))
    out = topo.merge_sheets(cells, sheets.drop("sheet")).select("idx", "focean_p", "fgice_p", "zatmo_p", "zicetop", "focean_m", "fgice_m", "zatmo_m", "fgrnd_m", "mergemask")
    return rounded(out, "focean_p", "fgice_p", "zatmo_p", "zicetop", "fgice_m", "zatmo_m", "fgrnd_m")


@query(f"SELECT 'avg' AS name, count(*) FILTER (WHERE c_acctbal IS NULL) AS n_null, CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_inf, count(*) FILTER (WHERE c_acctbal = 0) AS n_zero, count(*) FILTER (WHERE c_acctbal < 0) AS n_negative FROM customer")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return topo.bad_values(load(spark, sf, "customer").withColumnRenamed("c_acctbal", "avg"), ["avg"])


@query("SELECT c_custkey AS idx, round(1.0::DOUBLE - c_nationkey / 100.0 + c_nationkey % 2 / 4.0, 9) AS total FROM customer WHERE c_nationkey > 0 AND abs(- c_nationkey / 100.0 + c_nationkey % 2 / 4.0) > 1e-13")
def land_fraction_errors(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_nationkey")
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), (1 - n / 100.0).alias("focean"), (F.pmod(n, F.lit(2)) / 4.0).alias("flake"), F.lit(0.0).alias("fgrnd"), F.lit(0.0).alias("fgice"))
    return topo.bad_land_fractions(c).select("idx", F.round("total", 9).alias("total"))


# -- ocean and atmosphere -----------------------------------------------------------------------------------------------
_FOCEAN = f"SELECT CAST(i AS BIGINT) AS idx, (i % 5) / 8.0::DOUBLE AS focean_p, CASE WHEN i % 5 = 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS focean_m FROM range({A16.size}) t(i)"


def _focean(spark: SparkSession) -> DataFrame:
    k = F.pmod("id", F.lit(5))
    return spark.range(A16.size).select(F.col("id").alias("idx"), (k / 8.0).alias("focean_p"), F.when(k == 4, 1.0).otherwise(0.0).alias("focean_m"))


@query(f"SELECT idx, round(1 / (1 - focean_p), 9) AS w FROM ({_FOCEAN}) WHERE focean_m = 0 AND focean_p <> 1")
def ocean_scale(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ocean.ocean_scale(_focean(spark)), "w", digits=9)


_EO = f"SELECT CAST((p_size % 3) * {A16.size} + p_partkey % {A16.size} AS BIGINT) AS row, p_partkey % {A16.size} AS col, sum(1.0::DOUBLE + p_size) AS val FROM part GROUP BY 1, 2"


def _eo(spark: SparkSession, sf: str) -> DataFrame:
    col = F.pmod("p_partkey", F.lit(A16.size))
    return load(spark, sf, "part").groupBy((F.pmod("p_size", F.lit(3)) * A16.size + col).alias("row"), col.alias("col")).agg(F.sum(F.col("p_size") + 1.0).alias("val"))


@query(f"""WITH m AS ({_EO}), f AS ({_FOCEAN}), p AS (SELECT DISTINCT jb * {B8.im} + ib AS a, ja * {A16.im} + ia AS o FROM ({pairs_sql(B8, A16)})),
  c AS (SELECT row, col, val / sum(val) OVER (PARTITION BY col) * (1.0::DOUBLE + col % 3) AS v FROM m JOIN f ON f.idx = col AND focean_m = 0),
  g AS (SELECT a AS row, row // {A16.size} * {B8.size} + a AS col, sum(v) AS v FROM c JOIN p ON o = c.col GROUP BY 1, 2)
  SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(v / sum(v) OVER (PARTITION BY row), 9) AS val FROM g""")
def ave_from_ocean(spark: SparkSession, sf: str) -> DataFrame:
    w = spark.range(A16.size).select(F.col("id").alias("idx"), (F.pmod("id", F.lit(3)) + 1.0).alias("w"))
    return rounded(ocean.atmosphere_from_ocean_classes(_eo(spark, sf), _focean(spark), A16, B8, w), "val", digits=9)


@query(f"""WITH p AS (SELECT DISTINCT jb * {B8.im} + ib AS a, ja * {A16.im} + ia AS o FROM ({pairs_sql(B8, A16)}))
  SELECT row, CAST(row // {A16.size} * {B8.size} + a AS BIGINT) AS col, w AS val FROM (SELECT row, sum(val) AS w FROM ({_EO}) GROUP BY 1) JOIN p ON o = row % {A16.size}""")
def eo_to_ea(spark: SparkSession, sf: str) -> DataFrame:
    return ocean.class_pairs(spark, A16, B8, coo.sums(_eo(spark, sf)))


def _mismatched(spark: SparkSession, sf: str):
    from .regridder import MismatchedRegridder, Regridder

    x = exchange(spark, sf).withColumn("a_id", F.pmod("a_id", F.lit(A16.size)))
    areas = spark.range(A16.size).select(F.col("id").alias("a_id"), F.lit(1.0).alias("native_area"))
    base = Regridder(spark, areas, A16.size, HCDEFS, correct_a=False)
    base.add_sheet("s", x)
    return MismatchedRegridder(base, A16, _focean(spark))


for _spec, _scale in (("AvI", True), ("IvE", True), ("EvA", True), ("AvE", True), ("EvI", False), ("IvA", False)):
    _b, _a = _spec.split("v")
    _k = lambda s: {"A": "ao", "E": f"ihc * {B8.size} + ao", "I": "i_id"}[s]
    query(f"""WITH {FACTS}, f AS ({_FOCEAN}), q AS (SELECT DISTINCT jb * {B8.im} + ib AS ao, ja * {A16.im} + ia AS o FROM ({pairs_sql(B8, A16)})),
      y AS (SELECT i_id, ihc, ao, area * w / (1 - focean_p) AS v FROM x JOIN br USING (i_id) JOIN f ON f.idx = a_id % {A16.size} AND focean_m = 0 JOIN q ON q.o = f.idx),
      z AS (SELECT CAST({_k(_b)} AS BIGINT) AS row, CAST({_k(_a)} AS BIGINT) AS col, sum(v) AS v FROM y GROUP BY 1, 2)
      SELECT row, col, round({'v / sum(v) OVER (PARTITION BY row)' if _scale else 'v'}, 6) AS val FROM z""", f"mismatched_{_spec.lower()}")(lambda spark, sf, s=_spec, scale=_scale: rounded(_mismatched(spark, sf).matrix("s", s, ice_mask(spark, sf), scale).M, "val"))


@query(f"WITH {FACTS} SELECT CAST(ihc AS INT) AS ihc, count(*) AS n, round(sum(area * w), 4) AS area FROM x JOIN br USING (i_id) GROUP BY 1")
def class_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from .queries_matrix import sheet

    g = sheet(spark, sf).g
    ihc = F.floor(F.col("E") / N_A).cast("int")
    return rounded(g.groupBy(ihc.alias("ihc")).agg(F.count("*").alias("n"), F.sum("area").alias("area")), "area", digits=4)


_FINE64 = HntrSpec(64, 32)


@query(f"""WITH i AS (SELECT p_partkey % {_FINE64.size} AS idx, max(p_retailprice) * 0.999983217 AS elev FROM part GROUP BY 1), h AS (SELECT CAST(k AS INT) AS ihc, 400.0::DOUBLE * k AS h FROM range(7) t(k)),
  f AS (SELECT idx, elev, (idx // 64) // 4 * 16 + (idx % 64) // 4 AS o, 2 * pi() / 64 * (sin(pi() / 32 * (idx // 64 + 1 - 16)) - sin(pi() / 32 * (idx // 64 - 16))) AS area FROM i),
  w AS (SELECT o, idx, ihc + d AS ihc, area * CASE d WHEN 0 THEN 1 - (elev - h) / 400 ELSE (elev - h) / 400 END AS v FROM f, h, (VALUES (0), (1)) t(d) WHERE ihc < 6 AND elev > h AND elev <= h + 400)
  SELECT CAST(ihc * {A16.size} + o AS BIGINT) AS row, CAST(o AS BIGINT) AS col, round(sum(v), 9) AS val FROM w WHERE v <> 0 GROUP BY 1, 2""")
def global_ec(spark: SparkSession, sf: str) -> DataFrame:
    """Areas of elevation classes by ocean cell, from a raster that nests in the ocean grid."""
    from .regridder import global_classes

    ice = load(spark, sf, "part").groupBy(F.pmod("p_partkey", F.lit(_FINE64.size)).alias("idx")).agg((F.max("p_retailprice") * 0.999983217).alias("elev"))
    m = global_classes(ice, _FINE64, A16, HCDEFS)["EvA"]
    return rounded(coo.scale(m.M, m.wM, "row"), "val", digits=9)


def _global_sql() -> str:
    """All matrices of the raster by their definition: sums over cells, or over cells and their classes, scaled by row."""
    key = {"A": "o", "E": f"ihc * {A16.size} + o", "I": "idx", "X": "idx"}
    parts = []
    for spec in SPECS:
        b, a = spec.split("v")
        u = f"SELECT {key[b]} AS row, {key[a]} AS col, sum({'v' if 'E' in spec else 'area'}) AS v FROM {'w' if 'E' in spec else 'f'} GROUP BY 1, 2"
        parts.append(f"SELECT '{spec}' AS spec, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(v / sum(v) OVER (PARTITION BY row), 9) AS val FROM ({u})")
    return f"""WITH i AS (SELECT p_partkey % {_FINE64.size} AS idx, max(p_retailprice) * 0.999983217 AS elev FROM part GROUP BY 1), h AS (SELECT CAST(k AS INT) AS ihc, 400.0::DOUBLE * k AS h FROM range(7) t(k)),
      f AS (SELECT idx, elev, (idx // 64) // 4 * 16 + (idx % 64) // 4 AS o, 2 * pi() / 64 * (sin(pi() / 32 * (idx // 64 + 1 - 16)) - sin(pi() / 32 * (idx // 64 - 16))) AS area FROM i),
      w AS (SELECT * FROM (SELECT o, idx, ihc + d AS ihc, area * CASE d WHEN 0 THEN 1 - (elev - h) / 400 ELSE (elev - h) / 400 END AS v FROM f, h, (VALUES (0), (1)) t(d) WHERE ihc < 6 AND elev > h AND elev <= h + 400) WHERE v <> 0)
      {' UNION ALL '.join(parts)}"""


@query(_global_sql())
def global_ec_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """All ten matrices of a raster that nests in the ocean grid, from facts stored once."""
    from .regridder import global_classes

    ice = load(spark, sf, "part").groupBy(F.pmod("p_partkey", F.lit(_FINE64.size)).alias("idx")).agg((F.max("p_retailprice") * 0.999983217).alias("elev"))
    own = global_classes(ice, _FINE64, A16, HCDEFS, path=shared_path(spark, "global"))
    parts = [m.M.select(F.lit(s).alias("spec"), "row", "col", "val") for s, m in own.items()]
    return rounded(reduce(DataFrame.union, parts), "val", digits=9)


# -- coupling -----------------------------------------------------------------------------------------------------------
_X = "SELECT CAST(event_id % 60 AS BIGINT) AS row, user_id % 12 AS col, sum(1.0::DOUBLE + event_id % 3) AS val FROM events WHERE event_id % 2 = {p} GROUP BY 1, 2"


@query(f"""WITH x0 AS ({_X.format(p=0)}), x1 AS ({_X.format(p=1)}), s0 AS (SELECT row, col, val / sum(val) OVER (PARTITION BY row) AS v FROM x0), s1 AS (SELECT row, col, val / sum(val) OVER (PARTITION BY row) AS v FROM x1),
  d AS (SELECT row, col, sum(v) AS v FROM (SELECT * FROM s0 UNION ALL SELECT row, col, -v FROM s1) GROUP BY 1, 2)
  SELECT x1.col AS row, d.col AS col, round(sum(x1.val * d.v) / any_value(w), 9) AS val FROM x1 JOIN d ON d.row = x1.row JOIN (SELECT col AS e, sum(val) AS w FROM x1 GROUP BY 1) ON e = x1.col GROUP BY 1, 2""")
def e1ve0(spark: SparkSession, sf: str) -> DataFrame:
    """How values move between classes from one step to the next."""
    ev = load(spark, sf, "events")
    m = lambda p: ev.filter(F.col("event_id") % 2 == p).groupBy(F.pmod("event_id", F.lit(60)).alias("row"), F.pmod("user_id", F.lit(12)).alias("col")).agg(F.sum(F.pmod("event_id", F.lit(3)) + 1.0).alias("val"))
    return rounded(coupling.class_change(m(1), m(0)), "val", digits=9)


@query("SELECT event_id AS idx, round(value / 86400 * 1.0, 9) AS flux, round(value * 1000 + 2 * (event_id % 5) + 273.15, 6) AS heat FROM events")
def contract_transform(spark: SparkSession, sf: str) -> DataFrame:
    a = contract.VarSet().add("mass", "kg m-2 day-1").add("energy", "kJ").add("k", "")
    b = contract.VarSet().add("flux", "kg m-2 s-1").add("heat", "J")
    t = contract.Transformer(a, b, [contract.Term("flux", "mass"), contract.Term("heat", "energy"), contract.Term("heat", "k", 2.0), contract.Term("heat", contract.UNIT, 273.15)])
    ev = load(spark, sf, "events").select(F.col("event_id").alias("idx"), F.col("value").alias("mass"), F.col("value").alias("energy"), F.pmod("event_id", F.lit(5)).cast("double").alias("k"))
    out = t.select(ev, "idx")
    return out.select("idx", F.round("flux", 9).alias("flux"), F.round("heat", 6).alias("heat"))


@query("SELECT event_id AS idx, round(value * 0.5 + 7, 6) AS value FROM events")
def affine_rescale(spark: SparkSession, sf: str) -> DataFrame:
    v = contract.VarSet().add("value", "m", mm=0.5, bb=7.0)
    return rounded(v.rescale(load(spark, sf, "events").select(F.col("event_id").alias("idx"), "value")), "value")


@query("SELECT CAST(floor((user_id // 16 % 8) * 3 / 8.0) AS INT) AS owner, count(*) AS n FROM events GROUP BY 1")
def domain_split(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy(coupling.owner(F.col("user_id"), 16, 8, 3).alias("owner")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id % 50 AS idx, sum(value) / sum(1.0::DOUBLE + event_id % 2) AS v FROM events GROUP BY 1) SELECT CAST(i AS BIGINT) AS idx, round(coalesce(v, i), 6) AS v FROM range(60) t(i) LEFT JOIN g ON g.idx = i""")
def apply_gcm_values(spark: SparkSession, sf: str) -> DataFrame:
    cur = spark.range(60).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("v"))
    up = load(spark, sf, "events").select(F.pmod("user_id", F.lit(50)).alias("idx"), (F.pmod("event_id", F.lit(2)) + 1.0).alias("weight"), F.col("value").alias("v"))
    return rounded(coupling.apply_to_model(cur, up, ["v"]), "v")


@query("""WITH n AS (SELECT c_custkey AS idx, CAST(c_nationkey % 4 = 0 AS INT) AS mask FROM customer), o AS (SELECT c_custkey AS idx, CAST(c_nationkey % 3 = 0 AS INT) AS mask FROM customer)
  SELECT n.idx, n.mask FROM n JOIN o USING (idx) WHERE n.mask <> 0 OR o.mask <> 0""")
def merged_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    m = lambda k: c.select(F.col("c_custkey").alias("idx"), (F.pmod("c_nationkey", F.lit(k)) == 0).cast("int").alias("mask"))
    return coupling.emit_merged(m(4), m(3))


@query("SELECT p_partkey, 'F' || p_partkey AS name, p_type AS description, 'm' AS units, p_brand AS source FROM part")
def title_metadata(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat(F.lit("F"), F.col("p_partkey").cast("string"), F.lit(": "), F.col("p_type"), F.lit(" (m)  "), F.col("p_brand"))
    return load(spark, sf, "part").select("p_partkey", *fortran.title_columns(title))


@query("SELECT * FROM (VALUES (1, 'a'), (1, 'c'), (4, 'b'), (4, 'c'), (5, 'c')) v(flag, name)")
def contract_flags(spark: SparkSession, sf: str) -> DataFrame:
    v = contract.VarSet().add("a", flags=1).add("b", flags=4).add("c", flags=5)
    return spark.createDataFrame([(f, x.name) for f in (1, 4, 5) for x in v.where(f)], "flag int, name string")
