"""Queries through the regridder's and the coupler's own interfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import LonLatSpec, RegridParams
from ..operators import coo, merging, topo
from ..operators.matrices import class_areas
from ..operators.smoothing import smoothing_matrix
from ..sources import gridgen, tables
from ..streaming import contract, coupling
from . import topography
from .queries_matrix import FACTS, matrix_sql, sheet
from .regridder import Regridder, merged_classes, projected_areas
from .registry import load, query
from .sample import AREAS, EXCHANGE, HCDEFS, ICE, N_A, RASTER, areas, exchange, extent, ice_mask, raster, rounded

_BY_DT = 1 / 86400.0
_GCM = f"SELECT CAST((s_suppkey % 7) * {N_A} + s_suppkey AS BIGINT) AS idx, 1.0::DOUBLE + k AS weight, s_acctbal * (1 + k) AS massxfer, 2.0::DOUBLE * s_suppkey * (1 + k) AS enthxfer, 86400.0::DOUBLE * s_nationkey * (1 + k) AS deltah FROM supplier, range(2) t(k)"


def _gcm(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier").crossJoin(spark.range(2).withColumnRenamed("id", "k"))
    k = F.col("k") + 1.0
    return s.select((F.pmod("s_suppkey", F.lit(7)) * N_A + F.col("s_suppkey")).alias("idx"), k.alias("weight"), (F.col("s_acctbal") * k).alias("massxfer"), (F.col("s_suppkey") * 2.0 * k).alias("enthxfer"), (F.col("s_nationkey") * 86400.0 * k).alias("deltah"))


_IVE = matrix_sql("IvE", True, True).removeprefix("WITH ").replace(" SELECT CAST(r AS BIGINT)", ", m AS (SELECT CAST(r AS BIGINT)", 1)


@query(f"WITH g AS (SELECT idx, sum(massxfer) / sum(weight) AS a, sum(enthxfer) / sum(weight) AS b, sum(deltah) / sum(weight) / 86400 AS c FROM ({_GCM}) GROUP BY 1), {_IVE.replace('round(', '(').replace(', 9) AS val', ') AS val')}) SELECT row AS idx, round(sum(val * a), 6) AS massxfer, round(sum(val * b), 6) AS enthxfer, round(sum(val * c), 6) AS deltah FROM m JOIN g ON idx = col GROUP BY 1")
def gcm_to_ice(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs of an ice model from class values that come in weighted parts."""
    there, _ = contract.setup("climate", "echo")
    m = sheet(spark, sf).matrix("IvE", RegridParams(True, True)).M
    return rounded(coupling.to_ice(m, _gcm(spark, sf), there, {"by_dt": _BY_DT}), "massxfer", "enthxfer", "deltah")


@query(f"""WITH {FACTS}, w AS (SELECT ihc * {N_A} + a_id AS e, i_id, sum(area * w) AS v FROM x JOIN br USING (i_id) GROUP BY 1, 2)
  SELECT CAST(e AS BIGINT) AS idx, round(sum(v), 4) AS weight, round(sum(v * elev), 3) AS elev, round(sum(v * p_size / 86400), 6) AS smb FROM w JOIN ({ICE}) USING (i_id) JOIN part ON p_partkey = i_id GROUP BY 1""")
def ice_to_gcm(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs of an ice model as sums over class cells, with their areas."""
    _, back = contract.setup("climate", "echo")
    size = load(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("mass"), F.lit(0.0).alias("enth"))
    out = ice_mask(spark, sf).withColumnRenamed("i_id", "idx").join(size, "idx")
    got = coupling.to_gcm(sheet(spark, sf).matrix("EvI", RegridParams(False, False)), out, back, {"by_dt": _BY_DT})
    return rounded(rounded(rounded(got.select("idx", "weight", "elev", "smb"), "weight", digits=4), "elev", digits=3), "smb")


@query(f"SELECT i_id, topg, thk FROM ({RASTER}) WHERE time = (SELECT max(time) FROM ({RASTER}))")
def last_time_slice(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.shared_path(spark, "raster")
    raster(spark, sf).write.parquet(path)
    return tables.last_step(spark, path).select("i_id", "topg", "thk")


@query(f"WITH {FACTS} SELECT CAST(ihc * {N_A} + a_id AS BIGINT) AS idx, round(sum(area * w), 6) AS w FROM x JOIN br USING (i_id) GROUP BY 1")
def class_cell_areas(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(class_areas(sheet(spark, sf)), "w")


@query(f"SELECT CAST(i AS BIGINT) AS idx, coalesce(proj_area, -1) AS w FROM (SELECT unnest(range(greatest(120, 21 + (SELECT max(s_suppkey) FROM supplier)))) AS i) LEFT JOIN ({AREAS}) ON a_id = i")
def atmosphere_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of all suppliers, and the fill for some ids beyond them."""
    a = areas(spark, sf)
    r = Regridder(spark, a.select("a_id", "native_area"), extent(a, "a_id", 120, 20), HCDEFS)
    r.add_sheet("s", exchange(spark, sf), proj_areas=a.select("a_id", "proj_area"))
    return r.weights("s", native=False, fill=-1.0)


@query(f"SELECT sheet, row, col, sum(area) AS val FROM (SELECT CASE WHEN i_id % 2 = 0 THEN 'even' ELSE 'odd' END AS sheet, a_id AS row, i_id AS col, area FROM ({EXCHANGE}) JOIN ({ICE}) USING (i_id)) GROUP BY 1, 2, 3")
def union_sheets(spark: SparkSession, sf: str) -> DataFrame:
    a = areas(spark, sf)
    r = Regridder(spark, a.select("a_id", "native_area"), N_A, HCDEFS, correct_a=False)
    x = exchange(spark, sf)
    for k, n in enumerate(("even", "odd")):
        r.add_sheet(n, x.filter(F.col("i_id") % 2 == k), proj_areas=a.select("a_id", "proj_area"))
    mask = ice_mask(spark, sf)
    return r.union_matrix("AvI", {"even": mask, "odd": mask}, RegridParams(False, False))


@query("""WITH p AS (SELECT (ja * 4 + ia) AS a_id, ord, x, y FROM (SELECT ia, ja, k AS ord, -60.0::DOUBLE + 10 * (ia + CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END) AS lon, 60.0::DOUBLE + 5 * (ja + CASE WHEN k IN (2, 3) THEN 1 ELSE 0 END) AS lat FROM range(4) a(ia), range(3) b(ja), range(4) c(k)),
    LATERAL (SELECT sqrt(2 / 298.257223563 - 1 / 298.257223563 / 298.257223563) AS e), LATERAL (SELECT 6378137.0::DOUBLE * cos(radians(71)) / sqrt(1 - e * e * pow(sin(radians(71)), 2)) * tan(pi() / 4 - radians(lat) / 2) * pow((1 + e * sin(radians(lat))) / (1 - e * sin(radians(lat))), e / 2) / (tan(pi() / 4 - radians(71) / 2) * pow((1 + e * sin(radians(71))) / (1 - e * sin(radians(71))), e / 2)) AS rho),
    LATERAL (SELECT rho * sin(radians(lon + 39)) AS x, -rho * cos(radians(lon + 39)) AS y))
  SELECT CAST(a.a_id AS BIGINT) AS a_id, round(abs(sum(a.x * b.y - b.x * a.y)) / 2 / 1e6, 4) AS km2 FROM p a JOIN p b ON a.a_id = b.a_id AND b.ord = (a.ord + 1) % 4 GROUP BY 1""")
def projected_cell_areas(spark: SparkSession, sf: str) -> DataFrame:
    cells = gridgen.lonlat_cells(spark, LonLatSpec((-60.0, -50.0, -40.0, -30.0, -20.0), (60.0, 65.0, 70.0, 75.0)))
    out = projected_areas(cells, "+proj=stere +lon_0=-39 +lat_0=90 +lat_ts=71.0 +ellps=WGS84")
    return rounded(out.select("a_id", (F.col("proj_area") / 1e6).alias("km2")), "km2", digits=4)


_PTS = "SELECT p_partkey AS idx, (p_partkey % 45)::DOUBLE AS x, (p_partkey // 45)::DOUBLE AS y, 1.0::DOUBLE + p_size % 3 AS area FROM part"


@query(f"""WITH {matrix_sql('IvA', True, False).removeprefix('WITH ').replace('round(', '(').replace(', 9) AS val', ') AS val').replace(' SELECT CAST(r AS BIGINT)', ', m AS (SELECT CAST(r AS BIGINT)', 1)}), q AS ({_PTS}),
  k AS (SELECT a.idx AS row, b.idx AS col, exp(-0.5 * (pow((a.x - b.x) / 0.6, 2) + pow((a.y - b.y) / 0.6, 2))) * b.area AS v FROM q a, q b WHERE abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND pow((a.x - b.x) / 0.6, 2) + pow((a.y - b.y) / 0.6, 2) < 4),
  s AS (SELECT row, col, v / sum(v) OVER (PARTITION BY row) AS v FROM k)
  SELECT s.row, m.col, round(sum(s.v * m.val), 6) AS val FROM s JOIN m ON m.row = s.col GROUP BY 1, 2""")
def iva_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    pts = load(spark, sf, "part").select(k.alias("idx"), F.pmod(k, F.lit(45)).cast("double").alias("x"), F.floor(k / 45).cast("double").alias("y"), F.lit(0.0).alias("z"), (F.pmod("p_size", F.lit(3)) + 1.0).alias("area"))
    m = sheet(spark, sf).smoothed("IvA", smoothing_matrix(pts, (0.6, 0.6, 0.0)), RegridParams(True, False))
    return rounded(m.M, "val")


@query(f"SELECT p_partkey AS idx, n.ihc * 10.0::DOUBLE + a AS value FROM (SELECT p_partkey, p_partkey % 20 AS a, CAST(min_by(ihc, abs(p_retailprice - h) * 1000 + ihc * 1e-6) AS INT) AS ihc FROM part, (SELECT CAST(k AS INT) AS ihc, 400.0::DOUBLE * k AS h FROM range(7) t(k)) GROUP BY 1, 2) n")
def nearest_class_lookup(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.range(20 * 7).select(F.col("id").alias("idx"), (F.floor(F.col("id") / 20) * 10.0 + F.pmod("id", F.lit(20))).alias("value"))
    cells = load(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.pmod("p_partkey", F.lit(20)).alias("a_id"), F.col("p_retailprice").alias("elev"))
    return topography.nearest_class_values(e, cells, HCDEFS, 20)


@query(f"""WITH l AS (SELECT (i_id % 3) * {N_A} + a_id AS row, i_id AS col, area AS v FROM ({EXCHANGE}) WHERE i_id % 2 = 0), g AS (SELECT (i_id % 2 + 3) * {N_A} + a_id AS row, i_id AS col, area AS v FROM ({EXCHANGE}) WHERE i_id % 2 = 1),
  h(ihc, new) AS (VALUES (0, 0), (1, 1), (2, 3), (3, 1), (4, 2))
  SELECT CAST(new * {N_A} + row % {N_A} AS BIGINT) AS row, col, sum(v) AS val FROM (SELECT * FROM l UNION ALL SELECT * FROM g) JOIN h ON ihc = row // {N_A} GROUP BY 1, 2""")
def merged_local_and_global(spark: SparkSession, sf: str) -> DataFrame:
    """Local classes at 0, 400 and 1200 m and global ones at 400 and 800 m as one set of four."""
    x = exchange(spark, sf)
    m = lambda k, n: x.filter(F.col("i_id") % 2 == k).select((F.pmod("i_id", F.lit(n)) * N_A + F.col("a_id")).alias("row"), F.col("i_id").alias("col"), F.col("area").alias("val"))
    return merged_classes(m(0, 3), m(1, 2), [0.0, 400.0, 1200.0], [400.0, 800.0], N_A, squash=True)[0]


@query("SELECT c_nationkey AS cell, round(sum(c_acctbal) / 10000, 6) AS total FROM customer GROUP BY 1 HAVING abs(sum(c_acctbal) / 10000) > 1e-13 AND abs(sum(c_acctbal) / 10000 - 1) > 1e-13")
def class_fraction_errors(spark: SparkSession, sf: str) -> DataFrame:
    f = load(spark, sf, "customer").select(F.col("c_nationkey").alias("cell"), (F.col("c_acctbal") / 10000).alias("fhc"))
    return rounded(topo.bad_class_fractions(f), "total")


@query(f"SELECT a_id AS row, CAST(i_id % 7 * {N_A} + a_id + CASE WHEN i_id % 100 = 0 THEN 1 ELSE 0 END AS BIGINT) AS col, area AS val FROM ({EXCHANGE}) WHERE i_id % 100 = 0")
def stray_entries(spark: SparkSession, sf: str) -> DataFrame:
    x = exchange(spark, sf)
    off = F.when(F.col("i_id") % 100 == 0, 1).otherwise(0)
    m = x.select(F.col("a_id").alias("row"), (F.pmod("i_id", F.lit(7)) * N_A + F.col("a_id") + off).alias("col"), F.col("area").alias("val"))
    return merging.check_local(m, N_A)


@query(f"SELECT a_id AS idx, round(sum(area * p_retailprice) / sum(area), 6) AS value FROM ({EXCHANGE}) JOIN ({ICE}) USING (i_id) JOIN part ON p_partkey = i_id GROUP BY 1")
def regrid_ice_field(spark: SparkSession, sf: str) -> DataFrame:
    """A field on the ice grid as area means on the atmosphere grid."""
    v = load(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value"))
    m = sheet(spark, sf).matrix("AvI", RegridParams(True, False))
    return rounded(coo.apply(m.M, v), "value")
