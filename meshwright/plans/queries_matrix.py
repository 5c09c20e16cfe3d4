"""Queries of sparse matrices, elevation classes and regridding matrices, against their definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import RegridParams
from ..operators import coo, elevation, l1, merging
from ..operators.matrices import SheetMatrices
from ..operators.smoothing import smoothing_matrix
from .registry import load, query
from .sample import AREAS, EXCHANGE, HCDEFS, ICE, N_A, RASTER, areas, exchange, extent, ice_mask, raster, rounded, rounded_shares

M = f"SELECT a_id AS row, i_id AS col, area AS val FROM ({EXCHANGE})"


def _m(spark: SparkSession, sf: str) -> DataFrame:
    return exchange(spark, sf).select(F.col("a_id").alias("row"), F.col("i_id").alias("col"), F.col("area").alias("val"))


@query(f"SELECT row AS idx, sum(val) AS w FROM ({M}) GROUP BY 1")
def coo_row_weights(spark: SparkSession, sf: str) -> DataFrame:
    return coo.sums(_m(spark, sf))


@query(f"SELECT col AS idx, round(1 / sum(val), 9) AS w FROM ({M}) GROUP BY 1")
def coo_inverse_column_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(coo.sums(_m(spark, sf), "col", invert=True), "w", digits=9)


@query(f"SELECT col AS row, row AS col, val FROM ({M})")
def coo_transpose(spark: SparkSession, sf: str) -> DataFrame:
    return coo.transpose(_m(spark, sf))


@query("SELECT l_suppkey AS row, l_partkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2")
def coo_consolidate(spark: SparkSession, sf: str) -> DataFrame:
    return coo.consolidate(load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val")))


@query(f"SELECT a.row, b.col, sum(a.val * b.val) AS val FROM (SELECT row, col % 50 AS col, sum(val) AS val FROM ({M}) GROUP BY 1, 2) a JOIN (SELECT col % 50 AS row, row % 20 AS col, sum(val) AS val FROM ({M}) GROUP BY 1, 2) b ON a.col = b.row GROUP BY 1, 2")
def coo_matmul(spark: SparkSession, sf: str) -> DataFrame:
    m = _m(spark, sf)
    left = coo.consolidate(m.withColumn("col", F.col("col") % 50))
    right = coo.consolidate(coo.transpose(m).withColumns({"row": F.col("row") % 50, "col": F.col("col") % 20}))
    return coo.multiply(left, right)


@query(f"SELECT row, col, round(m.val / a.native_area, 9) AS val FROM ({M}) m JOIN ({AREAS}) a ON a.a_id = m.row")
def coo_scale_rows(spark: SparkSession, sf: str) -> DataFrame:
    w = areas(spark, sf).select(F.col("a_id").alias("idx"), F.col("native_area").alias("w"))
    return rounded(coo.scale(_m(spark, sf), w, "row", invert=True), "val", digits=9)


@query(f"SELECT CAST(i AS BIGINT) AS idx, round(coalesce(v, -1), 4) AS value FROM (SELECT unnest(range(greatest(150, 51 + (SELECT max(l_suppkey) FROM lineitem)))) AS i) LEFT JOIN (SELECT row, sum(val * p_retailprice) AS v FROM ({M}) JOIN part ON p_partkey = col WHERE p_size % 2 = 0 GROUP BY row) ON row = i")
def coo_apply_fill(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of the product, and the fill for some ids beyond them."""
    v = load(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")).alias("value"))
    m = _m(spark, sf)
    return rounded(coo.apply(m, v, fill=-1.0, n=extent(m, "row", 150, 50)), "value", digits=4)


@query(f"SELECT row, col, val FROM ({M}) WHERE row IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def crop_dim(spark: SparkSession, sf: str) -> DataFrame:
    return coo.crop(_m(spark, sf), load(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("idx")))


@query(f"SELECT row, col, val FROM ({M}) WHERE col % 2 = 0 UNION ALL SELECT row + 5000, col, val FROM ({M}) WHERE col % 2 = 1")
def stack_ec_offset(spark: SparkSession, sf: str) -> DataFrame:
    m = _m(spark, sf)
    return merging.stack_classes(m.filter("col % 2 = 0"), m.filter("col % 2 = 1"), 5, 1000)


_MV = "SELECT l_partkey % 300 AS idx, l_quantity AS weight, l_extendedprice AS a, l_quantity * 2 AS b FROM lineitem"


@query(f"SELECT CAST(i AS BIGINT) AS idx, round(coalesce(sa / w, -1), 6) AS a, round(coalesce(sb / w, -1), 6) AS b FROM range(310) t(i) LEFT JOIN (SELECT idx, sum(weight) AS w, sum(a) * 0.001::DOUBLE AS sa, sum(b) * 0.001::DOUBLE AS sb FROM ({_MV}) GROUP BY idx) ON idx = i")
def multivec_dense(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select(F.pmod("l_partkey", F.lit(300)).alias("idx"), F.col("l_quantity").alias("weight"), F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 2).alias("b"))
    li = coo.concatenate(li.filter("a > 30000"), li.filter("not a > 30000"))
    return rounded(coo.densify(li, 310, ["a", "b"], fill=-1.0, factor=0.001), "a", "b")


# -- elevation ------------------------------------------------------------------------------------------------------
@query(f"SELECT 'land' AS kind, i_id, round(CASE WHEN mask = 0 THEN topg ELSE topg + thk END, 6) AS elev FROM ({RASTER}) WHERE time = 1 AND mask IN (0, 2, 3) UNION ALL SELECT 'ice', i_id, round(topg + thk, 6) FROM ({RASTER}) WHERE time = 1 AND mask IN (2, 3)")
def mask_to_elevmask(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(elevation.elevmasks(raster(spark, sf)), "elev")


HC = "(SELECT CAST(k AS INT) AS ihc, 400.0::DOUBLE * k AS h FROM range(7) t(k))"
BRACKET = f"""SELECT i_id, z, b.ihc + d AS ihc, CASE d WHEN 0 THEN 1 - (z - b.h) / 400 ELSE (z - b.h) / 400 END AS w
  FROM (SELECT i_id, greatest(elev, 0) AS z FROM ({ICE})), {HC} b, (VALUES (0), (1)) v(d) WHERE b.ihc < 6 AND (z > b.h OR b.ihc = 0) AND z <= b.h + 400"""


@query(f"SELECT i_id, CAST(ihc AS INT) AS ihc, round(w, 9) AS w FROM ({BRACKET}) WHERE w <> 0")
def elev_bracket(spark: SparkSession, sf: str) -> DataFrame:
    z = ice_mask(spark, sf).withColumn("elev", F.greatest("elev", F.lit(0.0)))
    return rounded(elevation.bracket(z, HCDEFS).select("i_id", "ihc", "w"), "w", digits=9)


@query(f"SELECT i_id, CAST(min_by(ihc, abs(elev - h) * 1000 + ihc * 1e-6) AS INT) AS ihc FROM ({ICE}), {HC} GROUP BY i_id")
def elev_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return elevation.nearest(ice_mask(spark, sf), HCDEFS).select("i_id", "ihc")


@query(f"SELECT floor(min(elev) / 200) * 200 AS lo, ceil(max(elev) / 200) * 200 AS hi, CAST(ceil(max(elev) / 200) - floor(min(elev) / 200) + 1 AS BIGINT) AS n FROM ({ICE})")
def class_range(spark: SparkSession, sf: str) -> DataFrame:
    return merging.class_range(ice_mask(spark, sf))


# -- regridding matrices --------------------------------------------------------------------------------------------
FACTS = f"""x AS (SELECT e.* FROM ({EXCHANGE}) e JOIN ({ICE}) USING (i_id)), br AS (SELECT i_id, ihc, w FROM ({BRACKET}) WHERE w <> 0),
  p AS (SELECT a_id, native_area / proj_area AS p FROM ({AREAS})),
  GvI AS (SELECT x_id AS g, i_id AS k, area AS v FROM x), GvX AS (SELECT x_id AS g, x_id AS k, 1.0::DOUBLE AS v FROM x),
  GvA AS (SELECT x_id AS g, a_id AS k, area AS v FROM x), GvE AS (SELECT x_id AS g, ihc * {N_A} + a_id AS k, area * w AS v FROM x JOIN br USING (i_id))"""


def matrix_sql(spec: str, scale: bool, correct: bool) -> str:
    """From the product of the two matrices to the exchange grid, with its diagonal between them."""
    b, a = spec.split("v")
    if a == "X" or b == "X":
        other = b if a == "X" else a
        u = f"SELECT k AS r, g AS c, v FROM Gv{other}" if a == "X" else f"SELECT g AS r, k AS c, v FROM Gv{other}"
    else:
        diag = "GvA" if {a, b} <= {"A", "E"} else "GvI"
        u = f"SELECT l.k AS r, t.k AS c, sum(l.v / s.v * t.v) AS v FROM Gv{b} l JOIN {diag} s ON l.g = s.g JOIN Gv{a} t ON l.g = t.g GROUP BY 1, 2"
    pr, pc = "(SELECT p FROM p WHERE a_id = r % " + str(N_A) + ")", "(SELECT p FROM p WHERE a_id = c % " + str(N_A) + ")"
    if not correct:
        val = "v / sum(v) OVER (PARTITION BY r)" if scale else "v"
    elif b in "AE" and a not in "AE":
        val = f"v / sum(v) OVER (PARTITION BY r) / {pr}" if scale else "v"
    elif b in "AE":
        val = f"v * {pc} / (sum(v) OVER (PARTITION BY r) * {pr})" if scale else f"v * {pc}"
    else:
        val = f"v * {pc} / sum(v) OVER (PARTITION BY r)" if scale else f"v * {pc}"
    return f"WITH {FACTS}, u AS ({u}) SELECT CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col, round({val}, 9) AS val FROM u"


def weights_sql(spec: str, correct: bool) -> str:
    b, a = spec.split("v")
    base = matrix_sql(spec, False, False).replace("round(v, 9)", "v")
    p = lambda k, on: f" * (SELECT p FROM p WHERE a_id = {k} % {N_A})" if correct and on else ""
    head, tail = base.rsplit(" SELECT ", 1)
    return f"{head}, z AS (SELECT {tail}), w AS (SELECT 'row' AS side, row AS idx, sum(val) AS s FROM z GROUP BY 2 UNION ALL SELECT 'col', col, sum(val) FROM z GROUP BY 2) SELECT side, idx, round(CASE side WHEN 'row' THEN s{p('idx', b in 'AE')} ELSE s{p('idx', a in 'AE')} END, 6) AS w FROM w"


def sheet(spark: SparkSession, sf: str, style: str = "z") -> SheetMatrices:
    return SheetMatrices(exchange(spark, sf), ice_mask(spark, sf), areas(spark, sf), HCDEFS, N_A, style)


def _register(spec: str, scale: bool, correct: bool) -> None:
    name = f"{spec.lower()}_{'scaled' if scale else 'unscaled'}{'_corrected' if correct else ''}"
    query(matrix_sql(spec, scale, correct), name)(lambda spark, sf: rounded(sheet(spark, sf).matrix(spec, RegridParams(scale, correct)).M, "val", digits=9))


for _spec in ("AvI", "IvA", "EvI", "IvE", "EvA", "AvE"):
    for _scale in (True, False):
        for _correct in (True, False):
            _register(_spec, _scale, _correct)
for _spec in ("AvX", "XvA", "EvX", "XvE"):
    _register(_spec, True, False)
for _spec in ("AvI", "IvE", "EvA"):
    for _correct in (True, False):

        def _weights(spark: SparkSession, sf: str, spec: str = _spec, correct: bool = _correct) -> DataFrame:
            m = sheet(spark, sf).matrix(spec, RegridParams(True, correct))
            both = m.wM.select(F.lit("row").alias("side"), "idx", "w").union(m.Mw.select(F.lit("col").alias("side"), "idx", "w"))
            return rounded(both, "w")

        query(weights_sql(_spec, _correct), f"{_spec.lower()}_weights{'_corrected' if _correct else ''}")(_weights)


@query(f"""WITH {FACTS}, n AS (SELECT i_id, CAST(min_by(ihc, abs(greatest(elev, 0) - h) * 1000 + ihc * 1e-6) AS INT) AS ihc FROM ({ICE}), {HC} GROUP BY i_id)
  SELECT CAST(ihc * {N_A} + a_id AS BIGINT) AS row, i_id AS col, sum(area) AS val FROM x JOIN n USING (i_id) GROUP BY 1, 2""")
def evi_nearest_class(spark: SparkSession, sf: str) -> DataFrame:
    return sheet(spark, sf, "class").ur("EvI")


@query(f"""WITH {FACTS}, u AS (SELECT a_id, i_id, sum(area) AS v FROM x GROUP BY 1, 2), t AS (SELECT a_id, sum(v * p_retailprice) / sum(v) AS f FROM u JOIN part ON p_partkey = i_id GROUP BY 1), w AS (SELECT a_id, sum(v) AS w FROM u GROUP BY 1)
  SELECT round((SELECT sum(v * p_retailprice) FROM u JOIN part ON p_partkey = i_id), 2) AS ice, round((SELECT sum(f * w) FROM t JOIN w USING (a_id)), 2) AS atmosphere""")
def avi_conservation(spark: SparkSession, sf: str) -> DataFrame:
    m = sheet(spark, sf).matrix("AvI", RegridParams(True, False))
    v = load(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value"))
    there = m.integral(m.apply(v)).withColumnRenamed("total", "atmosphere")
    return rounded(m.integral(v, "col").withColumnRenamed("total", "ice").crossJoin(there), "ice", "atmosphere", digits=2)


@query(f"SELECT i, count(DISTINCT a) AS n FROM (SELECT x.i_id AS i, x.a_id AS a FROM ({EXCHANGE}) x JOIN ({ICE}) USING (i_id) WHERE a_id % 3 = 0) GROUP BY i")
def filtered_domain(spark: SparkSession, sf: str) -> DataFrame:
    from .regridder import Regridder

    r = Regridder(spark, areas(spark, sf).select("a_id", "native_area"), N_A, HCDEFS)
    r.add_sheet("s", exchange(spark, sf), proj_areas=areas(spark, sf).select("a_id", "proj_area"))
    r = r.filtered(areas(spark, sf).filter("a_id % 3 = 0").select("a_id"))
    m = r.regrid_matrices("s", ice_mask(spark, sf), RegridParams(False, False)).matrix("IvA")
    return m.M.groupBy(F.col("row").alias("i")).agg(F.countDistinct("col").alias("n"))


# -- smoothing, linear elements --------------------------------------------------------------------------------------
_PTS = "SELECT vec_id AS idx, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z, 1.0::DOUBLE + label % 3 AS area FROM embeddings"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda k: F.get("embedding", F.lit(k)).cast("double") * 10
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), (F.pmod("label", F.lit(3)) + 1.0).alias("area"))


for _name, _sx, _sy, _sz in (("smoothing_3d", 1.0, 1.5, 2.0), ("smoothing_2d", 0.5, 0.5, 0.0)):
    _d2 = f"pow((a.x - b.x) / {_sx}, 2) + pow((a.y - b.y) / {_sy}, 2)" + (f" + pow((a.z - b.z) / {_sz}, 2)" if _sz else "")
    query(f"WITH p AS ({_PTS}), r AS (SELECT a.idx AS row, b.idx AS col, exp(-0.5 * ({_d2})) * b.area AS v FROM p a, p b WHERE {_d2} < 4) SELECT row, col, round(v / sum(v) OVER (PARTITION BY row), 6) AS val FROM r", _name)(lambda spark, sf, s=(_sx, _sy, _sz): rounded_shares(smoothing_matrix(_points(spark, sf), s, parts=16), "val"))


@query("SELECT CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col, round(v, 9) AS val FROM (VALUES (0, 0, 2 / 3.0::DOUBLE), (0, 1, 2 / 3.0::DOUBLE), (0, 2, 2 / 3.0::DOUBLE), (0, 3, 2 / 3.0::DOUBLE), (0, 4, 4 / 3.0::DOUBLE)) t(r, c, v)")
def l1_basis(spark: SparkSession, sf: str) -> DataFrame:
    """Four triangles around the middle of a square, which one cell holds whole."""
    xy = {0: (-1.0, -1.0), 1: (1.0, -1.0), 2: (1.0, 1.0), 3: (-1.0, 1.0), 4: (0.0, 0.0)}
    tri = [(k, [(v, *xy[v]) for v in t]) for k, t in enumerate([(0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)])]
    elements = spark.createDataFrame(tri, "i_id long, ring array<struct<vid:long,x:double,y:double>>")
    return rounded(l1.basis_matrix(elements.select(F.lit(0).cast("long").alias("a_id"), "i_id", "ring"), elements), "val", digits=9)
