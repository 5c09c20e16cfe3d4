"""Properties: conservation, round trips, literal cases, errors."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meshwright.functions import geometry, units
from meshwright.functions.grids import NAMED, HntrSpec, Indexing, LonLatSpec, RegridParams, XYSpec, elevation_indexing, from_degrees_minutes, lonlat_from_hntr, searise
from meshwright.functions.projection import PolarStereographic
from meshwright.operators import coo, elevation, l1, merging, overlap_ll, overlap_poly, topo
from meshwright.operators.matrices import SheetMatrices
from meshwright.operators.smoothing import smoothing_matrix
from meshwright.plans import queries as own
from meshwright.plans.sample import rounded_shares
from meshwright.sources import gridgen

RING = "array<struct<vid:bigint,x:double,y:double>>"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("b,a", [(HntrSpec(8, 4), HntrSpec(16, 8)), (HntrSpec(4, 2), HntrSpec(8, 4)), (HntrSpec(10, 5, 0.5), HntrSpec(16, 8)), (HntrSpec(16, 8), HntrSpec(10, 5, 0.5)), (HntrSpec(12, 5), HntrSpec(8, 9))])
@pytest.mark.parametrize("radius", [1.0, 2.0])
def test_overlap_rows_and_columns_are_cell_areas(spark, b, a, radius):
    m = overlap_ll.overlap_matrix(spark, b, a, radius).cache()
    for axis, g in (("row", b), ("col", a)):
        for idx, w in rows(coo.sums(m, axis)):
            assert w == pytest.approx(radius**2 * g.row_area(idx // g.im), abs=1e-12)
    assert m.agg(F.sum("val")).first()[0] == pytest.approx(4 * math.pi * radius**2, rel=1e-12)
    assert m.filter("val < 1e-9").count() == 0


def test_row_areas_cover_the_sphere():
    for g in NAMED.values():
        if g.jm < 400:
            assert sum(g.row_area(j) for j in range(g.jm)) * g.im == pytest.approx(4 * math.pi, rel=1e-12)


def test_regrid_keeps_the_integral_of_a_ramp(spark):
    a, b = HntrSpec(16, 8), HntrSpec(8, 4)
    f = spark.range(a.size).select(F.col("id").alias("idx"), (F.pmod("id", F.lit(16)) + F.floor(F.col("id") / 16) + 2.0).alias("value"), F.lit(1.0).alias("weight"))
    area = lambda g: lambda idx: g.row_area(idx // g.im)
    before = sum(v * area(a)(i) for i, v, _ in rows(f))
    after = sum(v * area(b)(i) for i, v in rows(overlap_ll.regrid(f, b, a)))
    assert after == pytest.approx(before, rel=1e-12)
    m = overlap_ll.overlap_matrix(spark, b, a, scaled=True)
    by_matrix = dict(rows(coo.apply(m, f)))
    for i, v in rows(overlap_ll.regrid(f, b, a)):
        assert by_matrix[i] == pytest.approx(v, rel=1e-12)


def test_regrid_of_nothing_and_of_groups(spark):
    a, b = HntrSpec(16, 8), HntrSpec(8, 4)
    empty = spark.createDataFrame([], "idx long, value double, weight double")
    assert {v for _, v in rows(overlap_ll.regrid(empty, b, a, missing=-1.0))} == {-1.0}
    two = spark.createDataFrame([("x", 0, 1.0, 1.0), ("y", 0, None, 1.0)], "var string, idx long, value double, weight double")
    got = overlap_ll.regrid(two, b, a, by=("var",))
    assert got.count() == 64 and got.filter("value is not null").count() == 1


def test_grid_checks():
    with pytest.raises(ValueError):
        HntrSpec(9, 5).halved()
    with pytest.raises(ValueError):
        lonlat_from_hntr(HntrSpec(9, 5))
    with pytest.raises(ValueError):
        LonLatSpec((0, 1), (-90, 0), south_pole=True)
    with pytest.raises(ValueError):
        from_degrees_minutes(8, 4, 10, 0)
    assert searise().nx == 76 and searise().ny == 141
    ix = Indexing(("i", "j"), (1, 1), (4, 3), (1, 0))
    assert [ix.to_tuple(k) for k in range(12)] == [(i, j) for j in (1, 2, 3) for i in (1, 2, 3, 4)]
    assert all(ix.to_index(*ix.to_tuple(k)) == k for k in range(12))
    assert elevation_indexing(ix, 5).to_index(3, 2) == 2 * 12 + 3 and ix.with_extent("j", 7).size == 28


def test_hntr_grid_is_the_boundary_grid(spark):
    a = LonLatSpec((-180, -90, 0, 90, 180), (-90, -45, 0, 45, 90))
    assert rows(gridgen.lonlat_cells(spark, a).orderBy("cell_id")) == rows(gridgen.lonlat_cells(spark, lonlat_from_hntr(HntrSpec(4, 4))).orderBy("cell_id"))


def test_caps_and_cells_cover_the_sphere(spark):
    for p in (1, 3):
        s = lonlat_from_hntr(HntrSpec(8, 6), pole_caps=True, points_in_side=p)
        g = gridgen.lonlat_cells(spark, s).cache()
        assert g.agg(F.sum("native_area")).first()[0] == pytest.approx(4 * math.pi, rel=1e-12)
        assert g.filter("ring is null or exists(ring, v -> v.x is null or v.y is null)").count() == 0
        assert g.filter(geometry.shoelace(F.col("ring")) <= 0).filter("j between 1 and 4").count() == 0


def test_shapes(spark):
    df = spark.createDataFrame([([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 2.0, 2.0), (3, 0.0, 2.0)],), ([(0, 0.0, 0.0), (1, 3.0, 0.0), (2, 0.0, 3.0)],), ([],)], f"ring {RING}")
    x, y = geometry.centroid(F.col("ring"))
    assert rows(df.select(geometry.shoelace(F.col("ring")), x, y)) == [(4.0, 1.0, 1.0), (4.5, 1.0, 1.0), (0.0, None, None)]
    a, b, c = geometry.plane_through([F.lit(0.0), F.lit(1.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)], [F.lit(1.0), F.lit(0.0), F.lit(0.0)])
    tri = spark.createDataFrame([([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0)],)], f"ring {RING}")
    assert tri.select(geometry.plane_integral(F.col("ring"), a, b, c)).first()[0] == pytest.approx(0.5 / 3)


def test_two_cell_grid_round_trip(spark, tmp_path):
    from meshwright.sources import tables

    spec = XYSpec((0.0, 1.0, 2.0), (0.0, 1.0))
    cells = gridgen.xy_cells(spark, spec)
    tables.write_grid(cells, spec, f"file://{tmp_path}", "two")
    back, got, head = tables.read_grid(spark, f"file://{tmp_path}")
    assert got == spec and head["n_full"] == 2 and rows(back.orderBy("cell_id")) == rows(cells.orderBy("cell_id"))
    assert "ring" not in tables.read_grid(spark, f"file://{tmp_path}", full=False)[0].columns
    with pytest.raises(ValueError):
        tables.write_grid(cells.union(cells), spec, f"file://{tmp_path}/x", "twice")
    numbered, vertices = gridgen.number_vertices(cells)
    assert vertices.count() == 6 and numbered.count() == 2
    kept, used = gridgen.cells_of(numbered, F.col("cell_id") == 1)
    assert kept.count() == 1 and used.count() == 4


def test_exchange_grid_covers_both_grids(spark):
    a = gridgen.xy_cells(spark, XYSpec.between(-4, 8, 3.7, -4, 8, 2.9))
    turned = lambda x, y: (0.8 * x - 0.6 * y, 0.6 * x + 0.8 * y)
    ring = F.transform("ring", lambda v: F.struct(v["vid"].alias("vid"), turned(v["x"], v["y"])[0].alias("x"), turned(v["x"], v["y"])[1].alias("y")))
    i = gridgen.xy_cells(spark, XYSpec.between(0, 4, 0.5, 0, 4, 0.7)).withColumn("ring", ring)
    x = overlap_poly.exchange_grid(a, i, rings=True).cache()
    inside = i.filter("forall(ring, v -> v.x between -4 and 8 and v.y between -4 and 8)").select(F.col("cell_id").alias("i_id"), geometry.shoelace(F.col("ring")).alias("whole"))
    for _, got, whole in rows(x.groupBy("i_id").agg(F.sum("area").alias("got")).join(inside, "i_id")):
        assert got == pytest.approx(whole, rel=1e-9)
    assert x.filter(F.abs(geometry.shoelace(F.col("ring")) - F.col("area")) > 1e-12).count() == 0
    assert x.select("a_id", "i_id").distinct().count() == x.count()
    dart = spark.createDataFrame([(0, [(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 0.5, 0.5), (3, 0.0, 2.0)])], f"cell_id long, ring {RING}")
    assert overlap_poly.exchange_grid(a, dart).agg(F.sum("area")).first()[0] == pytest.approx(1.0)
    with pytest.raises(PySparkException):
        overlap_poly.exchange_grid(dart, dart, rings=True).collect()


def test_projection_round_trip_and_published_value(spark):
    p = PolarStereographic.parse("+proj=stere +lon_0=-39 +lat_0=90 +lat_ts=71.0 +ellps=WGS84")
    df = spark.createDataFrame([(float(lon), lat) for lon in (-179, -39, 0, 120) for lat in (60.0, 71.0, 89.0)], "lon double, lat double")
    x, y = p.forward(F.col("lon"), F.col("lat"))
    lon, lat = p.inverse(F.col("x"), F.col("y"))
    for a, b, c, d in rows(df.withColumns({"x": x, "y": y}).select("lon", "lat", lon, lat)):
        assert (c, d) == pytest.approx((a, b), abs=1e-8)
    # on the true-scale parallel the radius is a cos(lat) / sqrt(1 - e^2 sin^2 lat)
    e2, s = 0.00669437999014, math.sin(math.radians(71))
    x, y = p.forward(F.lit(51.0), F.lit(71.0))
    got = spark.range(1).select(x, y).first()
    assert got[0] == pytest.approx(6378137 * math.cos(math.radians(71)) / math.sqrt(1 - e2 * s * s)) and abs(got[1]) < 1e-6
    with pytest.raises(ValueError):
        PolarStereographic.parse("+proj=utm +zone=10")


def sheet(spark, correct_p=True):
    x = spark.createDataFrame([(k, k % 4, k % 10, 1.0 + k % 3) for k in range(40)] + [(99, 1, 2, 0.0)], "x_id long, a_id long, i_id long, area double")
    mask = spark.createDataFrame([(i, 90.0 * i - 20) for i in range(10) if i != 5], "i_id long, elev double")
    areas = spark.createDataFrame([(a, 20.0 + a, 21.0) for a in range(4)], "a_id long, native_area double, proj_area double")
    return SheetMatrices(x, mask, areas, [0.0, 300.0, 600.0, 900.0], 4)


@pytest.mark.parametrize("spec", ["AvI", "IvA", "EvI", "IvE", "EvA", "AvE"])
@pytest.mark.parametrize("correct", [False, True])
def test_unscaled_is_weights_times_scaled(spark, spec, correct):
    m = sheet(spark)
    raw, scaled = (m.matrix(spec, RegridParams(s, correct)) for s in (False, True))
    again = {(r, c): v for r, c, v in rows(coo.scale(scaled.M, scaled.wM, "row"))}
    for r, c, v in rows(raw.M):
        assert again[r, c] == pytest.approx(v, rel=1e-12)


def test_constants_survive_and_integrals_are_kept(spark):
    m = sheet(spark)
    p = RegridParams(True, False)
    one = spark.range(16).select(F.col("id").alias("idx"), F.lit(1.0).alias("value"))
    for spec in ("AvI", "EvI", "IvA", "IvE", "EvA", "AvE"):
        assert all(v == pytest.approx(1.0) for _, v in rows(m.matrix(spec, p).apply(one)))
    ramp = spark.range(16).select(F.col("id").alias("idx"), (F.col("id") * 1.5).alias("value"))
    for spec in ("AvI", "EvI", "AvE"):
        w = m.matrix(spec, p)
        assert w.integral(w.apply(ramp)).first()[0] == pytest.approx(w.integral(ramp, "col").first()[0], rel=1e-12)
    assert any(abs(v - 1) > 1e-3 for _, v in rows(m.matrix("AvI", RegridParams(True, True)).apply(one)))


def test_forced_conservation(spark):
    m = sheet(spark)
    w = m.matrix("IvA", RegridParams(True, False))
    pts = spark.createDataFrame([(i, float(i), 0.0, 0.0, 1.0) for i in range(10)], "idx long, x double, y double, z double, area double")
    s = coo.WeightedMatrix(coo.multiply(smoothing_matrix(pts, (1.0, 0.0, 0.0)), w.M), w.wM, w.Mw, False, True)
    v = spark.range(4).select(F.col("id").alias("idx"), (F.col("id") + 1.0).alias("value"))
    assert s.integral(s.apply(v, force_conservation=True)).first()[0] == pytest.approx(s.integral(v, "col").first()[0], rel=1e-12)


def test_elevation_edges(spark):
    z = spark.createDataFrame([(-50.0,), (0.0,), (100.0,), (150.0,), (200.0,)], "elev double")
    got = rows(elevation.bracket(z, [0.0, 100.0, 200.0]))
    assert got == [(-50.0, 0, 1.5), (-50.0, 1, -0.5), (0.0, 0, 1.0), (100.0, 1, 1.0), (150.0, 1, 0.5), (150.0, 2, 0.5), (200.0, 2, 1.0)]
    high = spark.createDataFrame([(250.0,)], "elev double")
    with pytest.raises(PySparkException):
        elevation.bracket(high, [0.0, 100.0, 200.0]).collect()
    assert rows(elevation.bracket(high, [0.0, 100.0, 200.0], clamp_top=True)) == [(250.0, 1, -0.5), (250.0, 2, 1.5)]
    near = spark.createDataFrame([(-9.0,), (50.0,), (51.0,), (900.0,)], "elev double")
    assert [r[1] for r in rows(elevation.nearest(near, [0.0, 100.0, 200.0]))] == [0, 0, 1, 2]


def test_mesh_of_four_triangles_in_two_cells(spark):
    xy = {0: (-1.0, -1.0), 1: (1.0, -1.0), 2: (1.0, 1.0), 3: (-1.0, 1.0), 4: (0.0, 0.0)}
    tri = [(k, [(v, *xy[v]) for v in t]) for k, t in enumerate([(0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)])]
    elements = spark.createDataFrame(tri, f"i_id long, ring {RING}")
    halves = gridgen.xy_cells(spark, XYSpec((-2.0, 0.0, 2.0), (-2.0, 2.0)))
    x = overlap_poly.exchange_grid(halves, elements.withColumnRenamed("i_id", "cell_id"), rings=True)
    m = l1.basis_matrix(x, elements).cache()
    assert dict(rows(coo.sums(m, "col"))) == pytest.approx({0: 2 / 3, 1: 2 / 3, 2: 2 / 3, 3: 2 / 3, 4: 4 / 3})
    assert dict(rows(coo.sums(m, "row"))) == pytest.approx({0: 2.0, 1: 2.0})


def test_smoothing_rejects_points_without_area(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0)], "idx long, x double, y double, z double, area double")
    with pytest.raises(PySparkException):
        smoothing_matrix(pts, (1.0, 1.0, 1.0)).collect()
    two = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0, 3.0)], "idx long, x double, y double, z double, area double")
    assert dict(rows(coo.sums(smoothing_matrix(two, (1.0, 0.0, 0.0), by_column=True), "col"))) == pytest.approx({0: 1.0, 1: 3.0})


def test_checks(spark):
    good = spark.createDataFrame([(0.25, 0.25, 0.25, 0.25)], "focean double, flake double, fgrnd double, fgice double")
    topo.require_none(topo.bad_land_fractions(good), "fractions")
    with pytest.raises(ValueError):
        topo.require_none(topo.bad_land_fractions(good.withColumn("flake", F.lit(0.5))), "fractions")
    fhc = spark.createDataFrame([(0, 0.5), (0, 0.5), (0, 1e-30), (1, 0.0), (2, 0.3)], "cell long, fhc double")
    assert [r[0] for r in rows(topo.bad_class_fractions(fhc))] == [2]
    m = spark.createDataFrame([(1, 11, 1.0), (1, 12, 1.0)], "row long, col long, val double")
    assert rows(merging.check_local(m, 10)) == [(1, 12, 1.0)]


def test_units():
    assert units.factor("kg m-2 day-1", "kg m-2 s-1") == pytest.approx(1 / 86400)
    with pytest.raises(ValueError):
        units.factor("kg", "m")
    assert units.date_365(0) == "19500101" and units.date_365(365 * 86400 * 2 + 59 * 86400) == "19520301"


def test_concave_polygons():
    import random

    from meshwright.operators import overlap_poly as op

    rng = random.Random(3)
    star = [(0.0, 0.0), (2.0, 0.5), (4.0, 0.0), (3.0, 2.0), (4.0, 4.0), (2.0, 3.0), (0.0, 4.0), (1.0, 2.0)]
    ell = [(1.0, 1.0), (5.0, 1.0), (5.0, 2.5), (2.5, 2.5), (2.5, 5.0), (1.0, 5.0)]
    for ring in (star, ell):
        parts = op.triangles(ring)
        assert not op.is_convex(ring) and sum(map(op.area, parts)) == pytest.approx(op.area(ring)) and all(op.area(t) >= 0 for t in parts)

    def inside(ring, x, y):
        return sum((ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2

    pts = [(rng.uniform(0, 5), rng.uniform(0, 5)) for _ in range(40000)]
    want = 25 * sum(inside(star, *p) and inside(ell, *p) for p in pts) / len(pts)
    size, ring = op.shared(star, ell, (False, False))
    assert ring is None and size == pytest.approx(want, abs=0.15) and op.shared(ell, star, (False, False))[0] == pytest.approx(size)
    box = [(0.5, 0.5), (3.5, 0.5), (3.5, 3.5), (0.5, 3.5)]
    assert op.shared(star, box, (False, True))[0] == pytest.approx(op.shared(box, star, (True, False))[0]) == pytest.approx(sum(max(0.0, op.area(op.clip(box, t))) for t in op.triangles(star)))


def test_grid_helpers():
    from meshwright.functions import grids

    assert grids.split_shape((2, 3, 4), 12) == ((2,), (3, 4)) and grids.split_shape((5,), 1) == ((5,), ())
    assert grids.parse_spec("EvA") == ("E", "A") and grids.parse_spec("AAmvEAm") == ("AAm", "EAm")
    assert grids.div_down(-7, 5) == -2 and grids.div_up(-7, 5) == -1
    h = grids.HntrSpec(16, 8)
    assert grids.matching_hntr(grids.lonlat_from_hntr(h, pole_caps=True), h) == h
    for bad in (lambda: grids.split_shape((2, 3), 4), lambda: grids.parse_spec("E"), lambda: grids.matching_hntr(grids.lonlat_from_hntr(h), grids.HntrSpec(8, 4))):
        with pytest.raises(ValueError):
            bad()


def test_smoothing_shuffles_no_pairs(spark):
    """Only points and sums by point are dealt out: each exchange is below the pairs' join, or of partial sums."""
    pts = spark.createDataFrame([(k, k % 7 * 0.4, k % 5 * 0.4, k * 0.1, 1.0 + k % 3) for k in range(60)], "idx long, x double, y double, z double, area double")
    want = {}
    for p in pts.collect():
        near = {q.idx: math.exp(-d2 / 2) * q.area for q in pts.collect() if (d2 := (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) < 4}
        want |= {(p.idx, c): v / sum(near.values()) for c, v in near.items()}
    for by_column in (False, True):
        df = smoothing_matrix(pts, (1.0, 1.0, 1.0), by_column=by_column)
        plan = df._jdf.queryExecution().executedPlan().toString()
        top = plan[: plan.index("SortMergeJoin")]
        assert "Exchange" not in top and "Broadcast" not in plan
        assert "(exp" not in plan[plan.index("SortMergeJoin") :].lower().replace("sum((exp", "")
        if not by_column:
            assert {(r, c): v for r, c, v in rows(df)} == pytest.approx(want)


def test_masks_are_never_broadcast(spark):
    plan = sheet(spark).matrix("IvA").M._jdf.queryExecution().executedPlan().toString()
    scans = plan.split("BroadcastExchange")[1:]
    assert not any("elev" in x.split("Join")[0] for x in scans) and "SortMergeJoin [i_id" in plan


def test_smoothed_matrices_shuffle_no_products(spark):
    """Entries meet a block's factors and are dealt out by block; only then they are multiplied, and nothing is broadcast."""
    pts = spark.createDataFrame([(k, float(k), 0.0, 0.0, 1.0 + k % 3) for k in range(8)], "idx long, x double, y double, z double, area double")
    m, s = sheet(spark), smoothing_matrix(pts, (1.0, 0.0, 0.0))
    got = m.smoothed("IvA", s).M
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode(to")] and "Broadcast" not in plan
    want = {(r, c): v for r, c, v in rows(coo.multiply(s, m.matrix("IvA").M))}
    assert want and {(r, c): v for r, c, v in rows(got)} == pytest.approx(want)


def test_product_by_blocks(spark):
    left = {(r, k): None if (r, k) == (3, 4) else r + 0.5 * k + 1 for r in range(-9, 30) for k in range(12) if (r * 7 + k) % 3}
    right = {(k, c): k - 0.25 * c for k in range(3, 15) for c in range(5) if (k + c) % 2}
    frame = lambda m, twice=(): spark.createDataFrame([(r, c, v) for (r, c), v in m.items()] + [(*x, m[x]) for x in twice], "row long, col long, val double")
    want = {}
    for (r, k), v in [*left.items(), ((5, 8), left[5, 8])]:
        for (k2, c), w in right.items():
            if k == k2:
                want[r, c] = want.get((r, c), 0.0) + (0.0 if v is None else v * w)
    for block in (1, 7, 1024):
        out = rows(coo.multiply_blocks(frame(left, [(5, 8)]), frame(right), block))
        assert len(out) == len(want) and {(r, c): v for r, c, v in out} == pytest.approx(want)


def test_smoothing_deals_the_rows_of_a_full_bucket_over_tasks(spark, tmp_path):
    """Vectors that share a bucket: no task makes most entries, and pow and the rounding through decimals, slow as they are, don't come back."""
    vectors = [(k, [0.01 + k % 17 * 0.005, 0.01 + k % 13 * 0.005, 0.01 + k % 11 * 0.005], k % 3) for k in range(200)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("smoothing_3d", "smoothing_2d"):
        df = own.queries()[name](spark, str(tmp_path))
        by_task = [n for _, n in rows(df.groupBy(F.spark_partition_id()).count())]
        assert sum(by_task) > 10000 and max(by_task) < 0.4 * sum(by_task)
        plan = df._jdf.queryExecution().executedPlan().toString().lower()
        assert "pow" not in plan and "round(" not in plan


def test_smoothing_in_parts_is_the_same_matrix(spark):
    """A row without neighbours, an id that occurs twice and negative places included."""
    pts = spark.createDataFrame([(k % 39, k % 7 * 0.4 - 1, k % 5 * -0.4, k * 0.1, 1.0 + k % 3) for k in range(40)] + [(99, 500.0, 0.0, 0.0, 2.0)], "idx long, x double, y double, z double, area double")
    for by_column in (False, True):
        whole, split = (sorted(rows(smoothing_matrix(pts, (1.0, 0.5, 1.5), by_column=by_column, parts=n))) for n in (1, 5))
        assert [x[:2] for x in whole] == [x[:2] for x in split] and [x[2] for x in split] == pytest.approx([x[2] for x in whole], rel=1e-12)
        assert (99, 99, 2.0 if by_column else 1.0) in split


def test_shares_are_rounded_as_duckdb_rounds(spark):
    import duckdb

    values = [0.0, 1.0, 0.5, 1 / 3, 4.9999999e-7, 5e-7, 1.5e-6, 2.5e-6, 1.25e-5, 0.1234565, 0.9999995, 0.99999949, 1e-300, *(k / 7919 for k in range(1, 7919, 13))]
    want = duckdb.execute("SELECT round(v, 6) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").coalesce(1)
    assert [v for v, in rows(rounded_shares(df, "v"))] == [*(v for v, in want), None]
