"""Queries through files, the coupling loop, and operators around the ocean grid and its classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, grids
from ..functions.grids import Indexing, RegridParams, XYSpec, elevation_indexing, lonlat_from_hntr
from ..operators import coo, elevation, l1, ocean, overlap_poly, topo
from ..operators.matrices import SheetMatrices
from ..sources import gridgen, tables
from ..streaming import contract, coupling
from . import topography
from .queries_grid import _overlap_sql, pairs_sql, regrid_sql
from .queries_matrix import FACTS, matrix_sql, sheet
from .queries_regridder import _BY_DT, _GCM, _gcm
from .queries_topo import _FOCEAN, _focean, _mismatched
from .regridder import Regridder, display_overlap, merged_a_v_e, on_display_grid
from .registry import load, query
from .sample import A16, AREAS, B8, COARSE, EXCHANGE, FIELD, HCDEFS, ICE, N_A, RASTER, areas, exchange, field, ice_mask, raster, rounded

# -- files --------------------------------------------------------------------------------------------------------------
_XY = XYSpec.between(-10, 18, 4.0, 3, 13, 2)
_XY_SQL = "SELECT CAST(j * 7 + i AS BIGINT) AS cell_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, 8.0::DOUBLE AS native_area, -10.0::DOUBLE + 4 * i + 2 AS cx, 3.0::DOUBLE + 2 * j + 1 AS cy, CAST(4 AS INT) AS n_vertices, CAST(35 AS BIGINT) AS n_full FROM range(7) a(i), range(5) b(j)"


def _with_head(cells: DataFrame, head: dict) -> DataFrame:
    return cells.withColumns({"n_vertices": F.size("ring"), "n_full": F.lit(head["n_full"]).cast("long")}).drop("ring")


@query(_XY_SQL)
def grid_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A grid written with its description, and read back."""
    path = tables.shared_path(spark, "grid")
    tables.write_grid(gridgen.xy_cells(spark, _XY).orderBy(F.desc("cell_id")), _XY, path, "xy")
    cells, spec, head = tables.read_grid(spark, path)
    if spec != _XY:
        raise ValueError("the description changed on the way")
    return _with_head(cells, head)


@query(_XY_SQL)
def grid_from_spec(spark: SparkSession, sf: str) -> DataFrame:
    """A grid generated from its description in JSON."""
    path = tables.shared_path(spark, "spec")
    return _with_head(tables.grid_from_spec(spark, tables.spec_to_json(_XY), path, "xy"), {"n_full": 35})


@query(f"SELECT x_id, a_id, i_id, area FROM ({EXCHANGE}) WHERE i_id % 2 = 1")
def exchange_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The exchange cells of one of two ice sheets in one table."""
    path = tables.shared_path(spark, "exchange")
    for k, name in enumerate(("even", "odd")):
        tables.write_exchange(exchange(spark, sf).filter(F.pmod("i_id", F.lit(2)) == k), path, name)
    return tables.read_exchange(spark, path, "odd")


@query(f"SELECT side, idx, round(w, 6) AS w FROM (SELECT 'row' AS side, a_id AS idx, sum(area) AS w FROM ({EXCHANGE}) JOIN ({ICE}) USING (i_id) GROUP BY 2 UNION ALL SELECT 'col', i_id, sum(area) FROM ({EXCHANGE}) JOIN ({ICE}) USING (i_id) GROUP BY 2 UNION ALL SELECT 'entries', a_id, sum(area) FROM ({EXCHANGE}) JOIN ({ICE}) USING (i_id) GROUP BY 2)")
def matrix_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A matrix with both weight vectors, written and read back."""
    path = tables.shared_path(spark, "matrix")
    tables.write_matrix(sheet(spark, sf).matrix("AvI", RegridParams(False, False)), path, "AvI")
    m = tables.read_matrix(spark, path, "AvI")
    if m.scaled or not m.conservative:
        raise ValueError("the flags changed on the way")
    side = lambda df, n: df.select(F.lit(n).alias("side"), "idx", "w")
    return rounded(side(m.wM, "row").union(side(m.Mw, "col")).union(side(coo.sums(m.M, "row"), "entries")), "w")


@query(f"WITH r AS (SELECT * FROM ({RASTER}) WHERE time = (SELECT max(time) FROM ({RASTER}))) SELECT 'ice' AS kind, i_id, topg + thk AS elev FROM r WHERE mask IN (2, 3) UNION ALL SELECT 'land', i_id, CASE WHEN mask = 0 THEN topg ELSE topg + thk END FROM r WHERE mask IN (0, 2, 3)")
def elevmask_reader(spark: SparkSession, sf: str) -> DataFrame:
    """Land and ice elevations of the last time slice of ice model output, by ``type:path``."""
    path = tables.shared_path(spark, "pism")
    raster(spark, sf).write.parquet(path)
    return tables.read_elevmask(spark, f"pism:{path}").select("kind", "i_id", "elev")


@query("SELECT p_partkey AS idx, p_retailprice * 2 AS value FROM part")
def appended_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The last step of a log along time, whose steps were written twice."""
    path = tables.shared_path(spark, "log")
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value"))
    for step in (0, 1, 1, 0):
        tables.append_step(p.withColumn("value", F.col("value") * (step + 1)), path, step)
    return tables.last_step(spark, path, "step").select("idx", "value")


@query("SELECT CAST(n_nationkey // 5 AS INT) AS j, CAST(n_nationkey % 5 AS INT) AS i, CAST(n_regionkey AS INT) AS region, c AS customers, b AS balance FROM nation JOIN (SELECT c_nationkey, count(*) AS c, round(sum(c_acctbal), 4) AS b FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def named_fields(spark: SparkSession, sf: str) -> DataFrame:
    """One wide table of fields that are named with their file and column."""
    a, b = tables.shared_path(spark, "nation"), tables.shared_path(spark, "customer")
    place = lambda k: [F.expr(f"cast({k} div 5 as int)").alias("j"), F.pmod(k, F.lit(5)).cast("int").alias("i")]
    load(spark, sf, "nation").select(*place("n_nationkey"), F.col("n_regionkey").cast("int").alias("r")).write.parquet(a)
    load(spark, sf, "customer").groupBy(*place("c_nationkey")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 4).alias("b")).write.parquet(b)
    return tables.named_variables(spark, {"region": (a, "r"), "customers": (b, "n"), "balance": (b, "b")})


@query("SELECT c_custkey AS idx, CAST(c_nationkey AS DOUBLE) AS zatmo, CAST(c_nationkey % 2 AS SMALLINT) AS mergemask FROM customer")
def topography_files(spark: SparkSession, sf: str) -> DataFrame:
    """Topography written with fields as doubles and masks as shorts."""
    path = tables.shared_path(spark, "topo")
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("zatmo"), F.pmod("c_nationkey", F.lit(2)).alias("mergemask"))
    tables.write_topography(c, path)
    out = spark.read.parquet(path)
    if [t for _, t in out.dtypes] != ["bigint", "double", "smallint"]:
        raise ValueError(f"wrong types: {out.dtypes}")
    return out


@query("""SELECT CAST(ja * 3 + ia AS BIGINT) AS a_id, CAST(ji * 8 + ii AS BIGINT) AS i_id, round(area, 9) AS area, n_a, n_i FROM (SELECT *, (least(4 * (ia + 1.0::DOUBLE), 1 + 1.25 * (ii + 1)) - greatest(4.0::DOUBLE * ia, 1 + 1.25 * ii)) * (least(3.0::DOUBLE * (ja + 1), -1 + 1.5 * (ji + 1)) - greatest(3.0::DOUBLE * ja, -1 + 1.5 * ji)) AS area, CAST(9 AS BIGINT) AS n_a, CAST(48 AS BIGINT) AS n_i
  FROM range(3) a(ia), range(3) b(ja), range(8) c(ii), range(6) d(ji)
  WHERE least(4 * (ia + 1), 1 + 1.25 * (ii + 1)) > greatest(4 * ia, 1 + 1.25 * ii) AND least(3 * (ja + 1), -1 + 1.5 * (ji + 1)) > greatest(3 * ja, -1 + 1.5 * ji)) WHERE area > 0""")
def overlap_files(spark: SparkSession, sf: str) -> DataFrame:
    """Two grids and their exchange grid written to one folder, and read back."""
    path = tables.shared_path(spark, "overlap")
    sa, si = XYSpec.between(0, 12, 4, 0, 9, 3), XYSpec.between(1, 11, 1.25, -1, 8, 1.5)
    a, i = gridgen.xy_cells(spark, sa), gridgen.xy_cells(spark, si)
    tables.write_overlap((a, sa, "A"), (i, si, "I"), overlap_poly.exchange_grid(a, i), path)
    (_, _, ha), (_, _, hi) = tables.read_grid(spark, f"{path}/A"), tables.read_grid(spark, f"{path}/I", full=False)
    x = tables.read_exchange(spark, f"{path}/exchange", "I")
    return rounded(x.select("a_id", "i_id", "area", F.lit(ha["n_full"]).cast("long").alias("n_a"), F.lit(hi["n_full"]).cast("long").alias("n_i")), "area", digits=9)


@query("SELECT p_partkey AS idx, CASE WHEN p_size % 3 = 2 THEN 1.0::DOUBLE ELSE CAST(p_size % 3 AS DOUBLE) END AS focean, CASE WHEN p_size % 3 = 2 THEN -300.0::DOUBLE ELSE p_retailprice END AS elev, p_size % 3 = 2 AS separated FROM part")
def separated_greenland(spark: SparkSession, sf: str) -> DataFrame:
    raw = load(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.pmod("p_size", F.lit(3)).cast("double").alias("focean"), F.col("p_retailprice").alias("elev"))
    rest, own = tables.separate_greenland(raw)
    return rest.join(own.select("idx", F.lit(True).alias("s")), "idx", "left").select("idx", "focean", "elev", F.coalesce("s", F.lit(False)).alias("separated"))


@query("SELECT * FROM (VALUES ('searise20', 76, 141), ('pism_greenland', 88, 152), ('mar_greenland', 60, 110)) v(name, nx, ny)")
def preset_grids(spark: SparkSession, sf: str) -> DataFrame:
    own = {n: grids.PRESETS[n]() for n in ("searise20", "pism_greenland", "mar_greenland")}
    return spark.createDataFrame([(n, g.nx, g.ny) for n, g in own.items()], "name string, nx int, ny int")


_NEAR = "SELECT i_id, CAST(min_by(k, abs(greatest(elev, 0) - 400.0::DOUBLE * k) * 1000 + k * 1e-6) AS BIGINT) AS ihc FROM (%s), range(7) t(k) GROUP BY 1" % ICE


@query(f"SELECT CAST(ihc * {N_A} + a_id AS BIGINT) AS row, i_id AS col, round(area, 6) AS val FROM ({EXCHANGE}) JOIN ({_NEAR}) USING (i_id)")
def regridder_reloaded(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet of nearest classes, with its ice cells, after the regridder was saved and loaded."""
    a = areas(spark, sf)
    r = Regridder(spark, a.select("a_id", "native_area"), N_A, HCDEFS)
    r.add_sheet("s", exchange(spark, sf), _ice_cells(spark, sf), a.select("a_id", "proj_area"), "class")
    path = tables.shared_path(spark, "regridder")
    r.save(path)
    back = Regridder.load(spark, path)
    if back.sheets["s"].ice_cells is None or back.sheets["s"].style != "class":
        raise ValueError("the sheet changed on the way")
    return rounded(back.regrid_matrices("s", ice_mask(spark, sf), RegridParams(False, False)).matrix("EvI").M, "val")


# -- grids and clips ----------------------------------------------------------------------------------------------------
@query(f"SELECT CAST(j * 16 + i AS BIGINT) AS idx, -180.0::DOUBLE + 22.5 * (i + 0.5) AS lon, (j + 0.5::DOUBLE - 4) * 22.5 AS lat FROM range({A16.im}) a(i), range({A16.jm}) b(j)")
def cell_centers(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(j * A16.im + i, A16.lon_center(i), A16.lat_center(j)) for j in range(A16.jm) for i in range(A16.im)]
    return spark.createDataFrame(rows, "idx long, lon double, lat double")


@query("SELECT s_suppkey, CAST((s_suppkey % 7) * 108 + s_suppkey % 108 AS BIGINT) AS e, CAST(s_suppkey % 108 AS BIGINT) AS a, CAST(s_suppkey % 7 AS BIGINT) AS ihc FROM supplier")
def elevation_index(spark: SparkSession, sf: str) -> DataFrame:
    """The index of a cell's elevation class, there and back."""
    ix = elevation_indexing(Indexing(("i", "j"), (0, 0), (12, 9), (1, 0)), 7)
    k = F.col("s_suppkey")
    t = load(spark, sf, "supplier").select(k, ix.index_column(F.pmod(k, F.lit(108)), F.pmod(k, F.lit(7))).alias("e"))
    a, ihc = ix.tuple_columns(F.col("e"))
    return t.withColumns({"a": a, "ihc": ihc})


@query("SELECT event_id, CAST(floor((event_id - 500) / 7.0::DOUBLE) AS BIGINT) AS down, CAST(ceil((event_id - 500) / 7.0::DOUBLE) AS BIGINT) AS up FROM events")
def whole_divisions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") - 500
    return load(spark, sf, "events").select("event_id", grids.div_down(k, 7).alias("down"), grids.div_up(k, 7).alias("up"))


_TRIANGLE = [(-80.0, 55.0), (20.0, 60.0), (-30.0, 88.0)]


def _separated() -> str:
    """SQL: a line along an edge of the triangle, with all corners of a cell beyond it."""
    out = []
    for (ax, ay), (bx, by) in zip(_TRIANGLE, _TRIANGLE[1:] + _TRIANGLE[:1], strict=True):
        side = [f"(({bx - ax}) * ({y} - {ay}) - ({by - ay}) * ({x} - ({ax})))" for x in ("w", "(w + 22.5)") for y in ("s", "(s + 22.5)")]
        out.append(f"greatest({', '.join(side)}) < 0")
    return " OR ".join(out)


@query(f"SELECT CAST(j * 16 + i AS BIGINT) AS cell_id FROM (SELECT i, j, -180.0::DOUBLE + 22.5 * i AS w, -90.0::DOUBLE + 22.5 * j AS s FROM range(16) a(i), range(8) b(j)) WHERE w <= 20 AND w + 22.5 >= -80 AND s <= 88 AND s + 22.5 >= 55 AND NOT ({_separated()})")
def lonlat_clip_polygon(spark: SparkSession, sf: str) -> DataFrame:
    return gridgen.lonlat_cells(spark, lonlat_from_hntr(A16), geometry.clip_polygon(_TRIANGLE), rings=False).select("cell_id")


def _corner_cells(spark: SparkSession, n: int, size: float, x0: float, flip: bool) -> DataFrame:
    """L-shaped cells: squares without their upper right quarter, or turned around without their lower left one."""
    h, k = size / 2, F.col("id")
    x, y = F.pmod(k, F.lit(n)) * size + x0, F.expr(f"id div {n}") * size
    own = [(0, 0), (size, 0), (size, h), (h, h), (h, size), (0, size)]
    pts = [(size - a, size - b) for a, b in own] if flip else own
    v = [F.struct(F.lit(None).cast("long").alias("vid"), (x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in pts]
    return spark.range(n * n).select(k.alias("cell_id"), F.array(*v).alias("ring"))


def _corner_sql(n: int, size: float, x0: float, flip: bool, k: str) -> str:
    """The two rectangles of each L-shaped cell."""
    h = size / 2
    a = f"SELECT CAST(j * {n} + i AS BIGINT) AS {k}, {x0}::DOUBLE + i * {size} AS x, j * {size}::DOUBLE AS y FROM range({n}) a(i), range({n}) b(j)"
    full, part = (h, 0.0) if flip else (0.0, h)
    left = h if flip else 0.0
    return f"SELECT {k}, x AS x0, x + {size} AS x1, y + {full} AS y0, y + {full} + {h} AS y1 FROM ({a}) UNION ALL SELECT {k}, x + {left}, x + {left} + {h}, y + {part}, y + {part} + {h} FROM ({a})"


@query(f"SELECT a_id, i_id, round(sum((least(a.x1, i.x1) - greatest(a.x0, i.x0)) * (least(a.y1, i.y1) - greatest(a.y0, i.y0))), 9) AS area FROM ({_corner_sql(3, 4.0, 0.0, False, 'a_id')}) a JOIN ({_corner_sql(5, 2.5, -1.0, True, 'i_id')}) i ON a.x0 < i.x1 AND i.x0 < a.x1 AND a.y0 < i.y1 AND i.y0 < a.y1 GROUP BY 1, 2")
def exchange_concave(spark: SparkSession, sf: str) -> DataFrame:
    """The areas that two grids of L-shaped cells share."""
    return rounded(overlap_poly.exchange_grid(_corner_cells(spark, 3, 4.0, 0.0, False), _corner_cells(spark, 5, 2.5, -1.0, True)), "area", digits=9)


@query("SELECT * FROM (VALUES ('row', 0, 4.0::DOUBLE), ('col', 0, 2 / 3.0::DOUBLE), ('col', 1, 2 / 3.0::DOUBLE), ('col', 2, 2 / 3.0::DOUBLE), ('col', 3, 2 / 3.0::DOUBLE), ('col', 4, 4 / 3.0::DOUBLE)) v(side, idx, w)".replace("SELECT *", "SELECT side, CAST(idx AS BIGINT) AS idx, round(w, 9) AS w"))
def l1_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Four triangles around a point, wholly in one cell."""
    v = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (0.0, 0.0)]
    ring = lambda t: [(n, *v[n]) for n in t]
    rows = [(k, ring(t)) for k, t in enumerate(((0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)))]
    elements = spark.createDataFrame(rows, f"i_id long, ring {geometry.RING}")
    m = l1.weighted_basis(elements.withColumn("a_id", F.lit(0).cast("long")), elements)
    return rounded(m.wM.select(F.lit("row").alias("side"), "idx", "w").union(m.Mw.select(F.lit("col"), "idx", "w")), "w", digits=9)


@query(f"""WITH z AS (SELECT p_partkey, p_retailprice * 3 - 500 AS z FROM part), b AS (SELECT *, least(greatest(CAST(ceil(z / 400) AS INT), 1), 6) AS hi FROM z)
  SELECT p_partkey, ihc, round(w, 9) AS w FROM (SELECT p_partkey, hi - 1 AS ihc, 1 - (z - 400 * (hi - 1)) / 400 AS w FROM b UNION ALL SELECT p_partkey, hi, (z - 400 * (hi - 1)) / 400 FROM b) WHERE w <> 0""")
def bracket_clamped(spark: SparkSession, sf: str) -> DataFrame:
    """Both neighbouring height points of each elevation; the outermost pairs extrapolate."""
    z = load(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") * 3 - 500).alias("elev"))
    return rounded(elevation.bracket(z, HCDEFS, clamp_top=True).select("p_partkey", "ihc", "w"), "w", digits=9)


# -- ocean and atmosphere -----------------------------------------------------------------------------------------------
@query(f"""WITH r AS ({regrid_sql(B8, A16, 0, 1)}), m AS (SELECT idx // {B8.im} AS j, avg(value) AS m FROM r GROUP BY 1)
  SELECT idx, round(CASE WHEN j IN (0, {B8.jm - 1}) THEN m ELSE value END, 6) AS value FROM r JOIN m ON idx // {B8.im} = j""")
def half_degree(spark: SparkSession, sf: str) -> DataFrame:
    """Plain means on a grid of half as many cells, one value for each pole."""
    return rounded(topography.half_degree(field(spark, sf).select("idx", F.col("value").alias("fgice")), A16, B8), "value")


for _spec, _sql in (("AOmvAAm", _overlap_sql(A16, B8, True)), ("AAmvAOm", _overlap_sql(B8, A16, True))):
    query(_sql, f"mismatched_{_spec.lower()}")(lambda spark, sf, s=_spec: rounded(_mismatched(spark, sf).matrix("s", s, ice_mask(spark, sf)).M, "val", digits=9))


@query(f"SELECT idx, 1.0::DOUBLE + idx % 3 AS w FROM ({_FOCEAN}) WHERE focean_m = 0 AND focean_p <> 1")
def continent_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = spark.range(A16.size).select(F.col("id").alias("idx"), (F.pmod("id", F.lit(3)) + 1.0).alias("w"))
    return ocean.continent_weights(_focean(spark), w)


def _classes(n: int, parity: int, offset: int) -> str:
    return f"SELECT CAST((p_size % {n} + {offset}) * {A16.size} + p_partkey % {A16.size} AS BIGINT) AS row, p_partkey % {A16.size} AS col, sum(1.0::DOUBLE + p_size) AS val FROM part WHERE p_partkey % 2 = {parity} GROUP BY 1, 2"


@query(f"""WITH m AS ({_classes(2, 0, 0)} UNION ALL {_classes(3, 1, 2)}), f AS ({_FOCEAN}), p AS (SELECT DISTINCT jb * {B8.im} + ib AS a, ja * {A16.im} + ia AS o FROM ({pairs_sql(B8, A16)})),
  c AS (SELECT row, col, val / sum(val) OVER (PARTITION BY col) * (1.0::DOUBLE + col % 3) AS v FROM m JOIN f ON f.idx = col AND focean_m = 0),
  g AS (SELECT a AS row, row // {A16.size} * {B8.size} + a AS col, sum(v) AS v FROM c JOIN p ON o = c.col GROUP BY 1, 2)
  SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(v / sum(v) OVER (PARTITION BY row), 9) AS val FROM g""")
def merged_global_ave(spark: SparkSession, sf: str) -> DataFrame:
    """A <- E over two local and three global classes."""

    def part(n: int, parity: int) -> DataFrame:
        col = F.pmod("p_partkey", F.lit(A16.size))
        return load(spark, sf, "part").filter(F.pmod("p_partkey", F.lit(2)) == parity).groupBy((F.pmod("p_size", F.lit(n)) * A16.size + col).alias("row"), col.alias("col")).agg(F.sum(F.col("p_size") + 1.0).alias("val"))

    w = spark.range(A16.size).select(F.col("id").alias("idx"), (F.pmod("id", F.lit(3)) + 1.0).alias("w"))
    m, _ = merged_a_v_e(part(2, 0), part(3, 1), [0.0, 400.0], [0.0, 800.0, 1600.0], _focean(spark), A16, B8, w)
    return rounded(m, "val", digits=9)


_FOLDED = f"SELECT l_partkey % {A16.size} AS row, l_suppkey AS col, sum(l_quantity) AS val FROM lineitem WHERE l_partkey % {A16.size} % 5 <> 0 GROUP BY 1, 2"


@query(f"""WITH m AS ({_FOLDED}), w AS (SELECT row, sum(val) AS w FROM m GROUP BY 1), d AS (SELECT row AS i, (row // 16) // 4 * 4 + (row % 16) // 4 AS k, 2 * pi() / 16 * (sin(pi() / 8 * (row // 16 + 1 - 4)) - sin(pi() / 8 * (row // 16 - 4))) AS area, w FROM w)
  SELECT CAST(k AS BIGINT) AS row, col, round(sum(area / w * val), 9) AS val, any_value(wk) AS weight FROM d JOIN m ON m.row = i JOIN (SELECT k AS kk, sum(w) AS wk FROM d GROUP BY 1) ON kk = k GROUP BY 1, 2""")
def display_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A matrix to a masked ice grid, as one to a display grid of a quarter of its resolution."""
    cell = F.pmod("l_partkey", F.lit(A16.size))
    m = load(spark, sf, "lineitem").filter(F.pmod(cell, F.lit(5)) != 0).groupBy(cell.alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").alias("val"))
    i_v_x = coo.WeightedMatrix(m, coo.sums(m, "row"), coo.sums(m, "col"), True, False)
    mask = m.select(F.col("row").alias("i_id"), F.lit(1.0).alias("elev")).distinct()
    out = on_display_grid(i_v_x, display_overlap(mask, A16, COARSE))
    return rounded(out.M.join(out.wM.select(F.col("idx").alias("row"), F.col("w").alias("weight")), "row"), "val", digits=9).select("row", "col", "val", "weight")


# -- topography and classes -----------------------------------------------------------------------------------------------
_LAND = f"SELECT i_id, CASE WHEN mask = 0 THEN topg ELSE topg + thk END AS elev FROM ({RASTER}) WHERE mask IN (0, 2, 3)"
_PART = lambda mask: f"(SELECT a_id AS idx, sum(area) * any_value(native_area) / any_value(proj_area) AS a, sum(area * elev) / sum(area) * any_value(native_area) AS z, min(elev) AS lo, max(elev) AS hi FROM ({EXCHANGE}) JOIN ({mask}) USING (i_id) JOIN ({AREAS}) USING (a_id) WHERE area > 0 GROUP BY 1)"


@query(f"SELECT idx, round(coalesce(l.a, 0), 6) AS da_cont, round(coalesce(i.a, 0), 6) AS da_ice, round(coalesce(l.z, 0), 6) AS da_zatmo, round(coalesce(i.z, 0), 6) AS da_zicetop, round(l.lo, 6) AS zland_min, round(l.hi, 6) AS zland_max FROM {_PART(_LAND)} l FULL JOIN {_PART(ICE)} i USING (idx)")
def sheet_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """What an ice sheet adds to each cell: areas of land and ice, and elevations."""
    land, _ = elevation.mask_to_elevation(F.col("mask"), F.col("topg"), F.col("thk"))
    on_land = raster(spark, sf).select("i_id", land.alias("elev")).filter("elev is not null")
    out = topo.sheet_deltas(exchange(spark, sf), areas(spark, sf), ice_mask(spark, sf), on_land)
    return rounded(out, "da_cont", "da_ice", "da_zatmo", "da_zicetop", "zland_min", "zland_max")


_CELLS = "SELECT CAST(p_size AS BIGINT) AS block, CAST(p_partkey // 10 AS INT) AS j, CAST(p_partkey % 10 AS INT) AS i, p_retailprice AS elev, 1.0::DOUBLE + p_partkey % 3 AS area FROM part"


@query(f"""WITH c AS ({_CELLS}), u AS (SELECT *, sum(area) OVER (PARTITION BY block ORDER BY elev DESC, j, i ROWS UNBOUNDED PRECEDING) AS upto, block % 4 * 9.5::DOUBLE AS budget FROM c)
  SELECT block, j, i, share, share >= 0.5 AS filled FROM (SELECT block, j, i, round(least(greatest((budget - upto + area) / area, 0), 1), 9) AS share FROM u)""")
def fill_shares(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    c = load(spark, sf, "part").select(F.col("p_size").cast("long").alias("block"), F.expr("cast(p_partkey div 10 as int)").alias("j"), F.pmod(k, F.lit(10)).cast("int").alias("i"), F.col("p_retailprice").alias("elev"), (F.pmod(k, F.lit(3)) + 1.0).alias("area"))
    budget = c.select("block").distinct().withColumn("budget", F.pmod("block", F.lit(4)) * 9.5)
    return rounded(topo.fill_shares(c, budget).select("block", "j", "i", "share", "filled"), "share", digits=9)


@query("SELECT c_custkey AS cell, CAST(c_nationkey % 6 AS INT) AS underice FROM customer WHERE c_nationkey % 6 IN (1, 2)")
def sent_classes(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("cell"), F.pmod("c_nationkey", F.lit(6)).cast("int").alias("underice"))
    return topo.sent_classes(c)


@query("SELECT c_custkey AS idx, c_acctbal AS w FROM customer WHERE c_custkey >= 40")
def base_weights(spark: SparkSession, sf: str) -> DataFrame:
    return topo.base_weights(load(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("w")), 40)


_BASE = f"SELECT CAST(k AS BIGINT) AS idx, 100.0::DOUBLE AS area, k % 3 / 4.0::DOUBLE AS focean_p, 0.1::DOUBLE AS fgice_p, 50.0::DOUBLE AS zatmo_p, 90.0::DOUBLE AS zicetop, CASE WHEN k % 3 = 1 AND k % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS focean_m, 0.05::DOUBLE AS flake_m FROM range({A16.size}) t(k)"


@query(f"""WITH b AS ({_BASE}), d AS (SELECT l_suppkey % {A16.size} AS idx, sum(l_tax) * 5 AS cont, sum(l_tax) * 2 AS ice, sum(l_discount) * 300 AS zatmo, sum(l_discount) * 700 AS ztop FROM lineitem GROUP BY 1),
  x AS (SELECT b.*, idx // 16 AS j, idx % 16 AS i, coalesce(cont, 0) <> 0 AS grew, coalesce(ice, 0) / area AS di, focean_p - coalesce(cont, 0) / area AS op, 0.1 + coalesce(ice, 0) / area AS ip, 50 + coalesce(zatmo, 0) / area AS zp, coalesce(ztop, 0) AS zt FROM b LEFT JOIN d USING (idx)),
  y AS (SELECT *, grew AND op < 0.5 AND focean_m = 1 AS t FROM x), z AS (SELECT *, CASE WHEN t THEN 0 ELSE focean_m END AS fm, CASE WHEN t THEN ip / (1 - op) ELSE 0 END AS gi, CASE WHEN t THEN zp / (1 - op) ELSE 0 END AS za FROM y),
  n AS (SELECT z.*, j BETWEEN 1 AND 6 AND i BETWEEN 1 AND 14 AND fm = 1 AND op <> 1 AND (SELECT max(o.fm) FROM z o WHERE abs(o.i - z.i) + abs(o.j - z.j) = 1) = 0 AS lone FROM z)
  SELECT idx, round(op, 6) AS focean_p, round(ip, 6) AS fgice_p, CASE WHEN lone THEN 0.0::DOUBLE ELSE CAST(fm AS DOUBLE) END AS focean_m, round(CASE WHEN lone THEN ip / (1 - op) ELSE gi END, 6) AS fgice_m, round(CASE WHEN lone THEN zp / (1 - op) ELSE za END, 6) AS zatmo_m, CAST(t OR zt <> 0 OR grew AND di <> 0 AS INT) AS mergemask FROM n""")
def topography_update(spark: SparkSession, sf: str) -> DataFrame:
    """Ocean-grid topography after a coupling step: ice sheets merged in, lone ocean cells filled."""
    k, lit = F.col("id"), lambda v: F.lit(float(v))
    wet = F.when((F.pmod(k, F.lit(3)) == 1) & (F.pmod(k, F.lit(2)) == 0), 1.0).otherwise(0.0)
    base = spark.range(A16.size).select(k.alias("idx"), lit(100).alias("area"), (F.pmod(k, F.lit(3)) / 4.0).alias("focean_p"), lit(0.1).alias("fgice_p"), lit(50).alias("zatmo_p"), lit(90).alias("zicetop"), wet.alias("focean_m"), lit(0.05).alias("flake_m"), lit(0).alias("fgrnd_m"), lit(0).alias("fgice_m"), lit(0).alias("zatmo_m"))
    li = load(spark, sf, "lineitem").withColumns({"idx": F.pmod("l_suppkey", F.lit(A16.size)), "half": F.pmod("l_orderkey", F.lit(2))})
    d = li.groupBy("idx", "half").agg((F.sum("l_tax") * 5).alias("da_cont"), (F.sum("l_tax") * 2).alias("da_ice"), (F.sum("l_discount") * 300).alias("da_zatmo"), (F.sum("l_discount") * 700).alias("da_zicetop"))
    out = coupling.Topography(base).update([d.filter("half = 0"), d.filter("half = 1")], A16.im, A16.jm)
    return rounded(out.select("idx", "focean_p", "fgice_p", "focean_m", "fgice_m", "zatmo_m", "mergemask"), "focean_p", "fgice_p", "focean_m", "fgice_m", "zatmo_m")


# -- coupling -----------------------------------------------------------------------------------------------------------
_KAPPA = 3.2217 / (2060.0 * 40)


@query(f"""WITH x AS (SELECT event_id AS idx, 95000.0::DOUBLE + event_id % 9 * 1000 + (value - 50) / {_KAPPA!r} AS h FROM events)
  SELECT idx, round(CASE WHEN h < 100450 THEN h / 2009 + 223.15 ELSE 273.15 END, 6) AS ice_top_bc_temp, round(CASE WHEN h > 100450 THEN (h - 100450) / 334000 ELSE 0 END, 6) AS ice_top_bc_wc FROM x""")
def surface_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """The temperature and water content that make a stated heat flux into the ice."""
    ev = load(spark, sf, "events").select(F.col("event_id").alias("idx"), (F.col("value") - 50).alias("deltah"), (F.pmod("event_id", F.lit(9)) * 1000 + 95000.0).alias("ice_top_senth"))
    out = contract.surface_boundary(ev, contract.conductivity({"rhoi": (1.0, "kg m-3"), "shi": (2060.0, "J kg-1 K-1"), "stieglitz_8b": (3.2217, "")}))
    return rounded(out.select("idx", "ice_top_bc_temp", "ice_top_bc_wc"), "ice_top_bc_temp", "ice_top_bc_wc")


@query("SELECT event_id AS idx, round(value / 86400, 9) AS massxfer, round(event_id % 5 + (100450.0::DOUBLE + 334000) * value / 86400, 9) AS enthxfer, round(value * 2 / 86400, 9) AS deltah FROM events")
def enthalpy_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Fluxes to an ice model that counts enthalpy from another zero."""
    there, _ = contract.setup("climate", "pism")
    ev = load(spark, sf, "events").select(F.col("event_id").alias("idx"), (F.col("value") / 86400).alias("massxfer"), F.pmod("event_id", F.lit(5)).cast("double").alias("enthxfer"), (F.col("value") * 2).alias("deltah"))
    out = there.select(ev, "idx", scalars={"by_dt": _BY_DT})
    return rounded(out, "massxfer", "enthxfer", "deltah", digits=9)


def _ice_cells(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, sf, "part").select(k.alias("cell_id"), F.pmod(k, F.lit(45)).cast("double").alias("cx"), F.floor(k / 45).cast("double").alias("cy"), (F.pmod("p_size", F.lit(3)) + 1.0).alias("native_area"))


def _coupler(spark: SparkSession, sf: str, sigma: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> coupling.Coupler:
    there, back = contract.setup("climate", "echo")
    model = coupling.ice_model("echo", elevation=ice_mask(spark, sf).withColumnRenamed("i_id", "idx"))
    s = coupling.Sheet("s", exchange(spark, sf), areas(spark, sf), HCDEFS, N_A, model, there, back, sigma=sigma, ice_cells=_ice_cells(spark, sf))
    return coupling.Coupler(spark, [s], tables.shared_path(spark, "coupling"))


def _unrounded(spec: str, name: str) -> str:
    """The SQL of a matrix as CTEs, its entries unrounded in one called ``name``."""
    sql = matrix_sql(spec, True, True).removeprefix("WITH ").replace("round(", "(").replace(", 9) AS val", ") AS val")
    return sql.replace(" SELECT CAST(r AS BIGINT)", f", {name} AS (SELECT CAST(r AS BIGINT)", 1) + ")"


_IVE = _unrounded("IvE", "ive")


@query(f"""WITH {_IVE}, q AS (SELECT p_partkey AS idx, (p_partkey % 45)::DOUBLE AS x, (p_partkey // 45)::DOUBLE AS y, 1.0::DOUBLE + p_size % 3 AS area FROM part JOIN ({ICE}) ON i_id = p_partkey),
  k AS (SELECT a.idx AS row, b.idx AS col, exp(-0.5 * (pow((a.x - b.x) / 0.6, 2) + pow((a.y - b.y) / 0.6, 2))) * b.area AS v FROM q a JOIN q b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 WHERE pow((a.x - b.x) / 0.6, 2) + pow((a.y - b.y) / 0.6, 2) < 4),
  s AS (SELECT row, col, v / sum(v) OVER (PARTITION BY row) AS v FROM k)
  SELECT s.row, round(sum(s.v * ive.val), 6) AS total, round(sum(s.v * ive.val * (ive.col % 89)), 4) AS mixed FROM s JOIN ive ON ive.row = s.col GROUP BY 1""")
def coupled_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix that a coupling step keeps for the next inputs, smoothed over the ice grid."""
    c = _coupler(spark, sf, (0.6, 0.6, 0.0))
    c.couple(0.0)
    m = c._state["s", "IvE"]
    return rounded(rounded(m.groupBy("row").agg(F.sum("val").alias("total"), F.sum(F.col("val") * F.pmod("col", F.lit(89))).alias("mixed")), "total"), "mixed", digits=4)


@query(f"""WITH {_IVE}, g AS (SELECT idx, sum(massxfer) / sum(weight) AS a FROM ({_GCM}) GROUP BY 1), i AS (SELECT row AS i_id, sum(val * a) AS mass FROM ive JOIN g ON idx = col GROUP BY 1),
  eui AS (SELECT ihc * {N_A} + a_id AS e, i_id, sum(area * w) AS v FROM x JOIN br USING (i_id) GROUP BY 1, 2)
  SELECT CAST(e AS BIGINT) AS idx, round(sum(v), 4) AS weight, round(sum(v * coalesce(mass, 0)), 3) AS smb FROM eui LEFT JOIN i USING (i_id) GROUP BY 1""")
def coupled_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A coupling step replayed from a directory of batches, after the one that starts the models."""
    c = _coupler(spark, sf)
    c.couple(0.0)
    batch = _gcm(spark, sf).select(F.lit(1).cast("long").alias("step"), F.lit(86400.0).alias("time"), "idx", "weight", "massxfer", "enthxfer", "deltah")
    batch.coalesce(1).write.parquet(f"{c.path}/in")
    c.replay(f"{c.path}/in", batch.schema, f"{c.path}/checkpoint")
    out = spark.read.parquet(f"{c.path}/gcm_in/kind=E/step=1").select("idx", "weight", "smb")
    return rounded(rounded(out, "weight", digits=4), "smb", digits=3)
