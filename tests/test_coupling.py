"""The coupling loop: steps, restart, replay; contracts; readers."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.operators import coo
from meshwright.sources import fortran, tables
from meshwright.streaming import contract, coupling

BATCH = "step long, time double, idx long, weight double, massxfer double, enthxfer double, deltah double"


def sheet(spark):
    x = spark.createDataFrame([(k, k % 4, k % 10, 1.0 + k % 3) for k in range(40)], "x_id long, a_id long, i_id long, area double")
    areas = spark.createDataFrame([(a, 20.0 + a, 21.0) for a in range(4)], "a_id long, native_area double, proj_area double")
    elev = spark.createDataFrame([(i, 90.0 * i) for i in range(10)], "idx long, elev double")
    there, back = contract.setup("climate", "echo")
    return coupling.Sheet("s", x, areas, [0.0, 300.0, 600.0, 900.0], 4, coupling.echo_model(elev), there, back)


def batch(spark, step):
    return spark.createDataFrame([(step, 86400.0 * step, e, 1.0 + e % 2, 1e-3 * e * (1 + e % 2), 1.0, 86400.0) for e in range(16)], BATCH)


def test_steps_restart_and_replay(spark, tmp_path):
    a = coupling.Coupler(spark, [sheet(spark)], f"file://{tmp_path}/a")
    first = a.couple(0.0)
    assert set(first) == {"E", "A"} and first["E"].filter("smb is not null").count() == 0
    one = a.couple(86400.0, batch(spark, 1))
    two = a.couple(172800.0, batch(spark, 2))
    assert one["E1vE0"].filter(F.abs("val") > 1e-12).count() == 0  # nothing moved between classes
    total = two["E"].agg(F.sum("smb")).first()[0]
    assert total > 0
    kept = sorted(map(tuple, two["E"].collect()))
    b = coupling.Coupler(spark, [sheet(spark)], f"file://{tmp_path}/a")
    b.restore(1, 86400.0)
    again = b.couple(172800.0, batch(spark, 2))
    assert sorted(map(tuple, again["E"].collect())) == kept
    with pytest.raises(ValueError):
        b.couple(1.0)
    c = coupling.Coupler(spark, [sheet(spark)], f"file://{tmp_path}/c")
    c.couple(0.0)
    for s in (1, 2):
        batch(spark, s).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    c.replay(f"file://{tmp_path}/in", batch(spark, 1).schema, f"file://{tmp_path}/ck")
    assert c.step == 2
    last = spark.read.parquet(f"file://{tmp_path}/c/gcm_in/kind=E/step=2").agg(F.sum("smb")).first()[0]
    assert last == pytest.approx(total)


def test_a_batch_that_comes_again_is_the_same_step(spark, tmp_path):
    """A step that failed before its mark was written is run again from the state before it, also by a new coupler."""
    path = f"file://{tmp_path}/c"
    c = coupling.Coupler(spark, [sheet(spark)], path)
    c.couple(0.0)
    rows = lambda df: sorted(tuple(None if x is None else round(x, 9) for x in r) for r in df.collect())
    want = rows(c.couple(86400.0, batch(spark, 1))["E"])
    failing = coupling.Coupler(spark, [sheet(spark)], f"file://{tmp_path}/d")
    failing.couple(0.0)
    model = failing.sheets[0].model

    def broken(*_):
        raise RuntimeError("the ice model stopped")

    failing.sheets[0].model = broken
    with pytest.raises(RuntimeError):
        failing.couple(86400.0, batch(spark, 1))
    assert (failing.step, failing.time) == (0, 0.0) and failing.written(1) is None
    failing.sheets[0].model = model
    assert rows(failing.couple(86400.0, batch(spark, 1))["E"]) == want
    for n in (1, 2):
        batch(spark, n).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    new = coupling.Coupler(spark, [sheet(spark)], path)  # step 1 is there already; its batch comes again
    new.replay(f"file://{tmp_path}/in", batch(spark, 1).schema, f"file://{tmp_path}/ck")
    assert new.step == 2 and new.written(2) == 172800.0
    again = spark.read.parquet(f"{path}/gcm_in/kind=E/step=1")
    assert rows(again) == want
    with pytest.raises(ValueError):
        new.restore(9)


def test_smoothing_changes_the_inputs_and_needs_cells(spark, tmp_path):
    s = sheet(spark)
    s.sigma = (1.0, 1.0, 0.0)
    with pytest.raises(ValueError):
        coupling.Coupler(spark, [s], f"file://{tmp_path}/a").couple(0.0)
    s.ice_cells = spark.createDataFrame([(i, float(i), 0.0, 1.0) for i in range(10)], "cell_id long, cx double, cy double, native_area double")
    a, b = coupling.Coupler(spark, [s], f"file://{tmp_path}/b"), coupling.Coupler(spark, [sheet(spark)], f"file://{tmp_path}/c")
    a.couple(0.0)
    b.couple(0.0)
    smooth, plain = a._state["s", "IvE"], b._state["s", "IvE"]
    assert smooth.count() > plain.count()


def test_topography_keeps_the_first_ocean_mask(spark):
    names = "idx long, area double, focean_p double, fgice_p double, zatmo_p double, zicetop double, focean_m double, flake_m double, fgrnd_m double, fgice_m double, zatmo_m double"
    base = spark.createDataFrame([(k, 10.0, 0.6, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0) for k in range(16)], names)
    deltas = lambda cont: spark.createDataFrame([(5, cont, 1.0, 20.0, 30.0)], "idx long, da_cont double, da_ice double, da_zatmo double, da_zicetop double")
    t = coupling.Topography(base)
    first = t.update([deltas(3.0)], 4, 4)
    t.freeze(first)
    second = t.update([deltas(0.5)], 4, 4)
    get = lambda df: {r["idx"]: (r["focean_m"], r["focean_p"], r["mergemask"]) for r in df.collect()}
    one, two = get(first), get(second)
    assert one[5][0] == 0.0 and one[4][0] == 1.0
    assert two[5][0] == 0.0 and two[5][1] == pytest.approx(0.55)  # the mask stays, the fraction doesn't
    sent = coupling.changed_topography(t.update([deltas(0.5).filter("idx < 0")], 4, 4), second)
    assert [r["idx"] for r in sent.collect()] == [5]


def test_external_models():
    assert coupling.command_line(["run"], {"i": "a.nc", "y": "10"}, {"i": "restart.nc"}) == ["run", "-i", "restart.nc", "-y", "10"]
    with pytest.raises(ValueError):
        coupling.ice_model("other")


def test_class_change_is_a_change_of_basis(spark):
    x0 = spark.createDataFrame([(0, 0, 2.0), (1, 0, 1.0), (1, 1, 1.0), (2, 1, 3.0)], "row long, col long, val double")
    x1 = spark.createDataFrame([(0, 1, 2.0), (1, 0, 1.0), (1, 1, 1.0), (2, 1, 3.0)], "row long, col long, val double")
    m = coupling.class_change(x1, x0)
    value = {0: 5.0, 1: 7.0}
    change = {}
    for r, c, v in map(tuple, m.collect()):
        change[r] = change.get(r, 0) + v * value[c]
    on_x = {0: 5.0, 1: 6.0, 2: 7.0}
    new_1 = {0: 7.0, 1: 6.0, 2: 7.0}
    want = sum((on_x[x] - new_1[x]) * w for x, w in ((0, 2.0), (1, 1.0), (2, 3.0))) / 6
    assert change[1] == pytest.approx(want)


def test_contracts():
    v = contract.VarSet().add("a", "m", contract.GRID_ICE | contract.INITIAL)
    with pytest.raises(ValueError):
        v.add("a")
    assert contract.flag_text(v["a"].flags) == "ICE|INITIAL" and v.where(contract.GRID_ICE) == v.vars
    assert v.schema(("idx", "long"))["a"].metadata["units"] == "m"
    with pytest.raises(ValueError):
        contract.Transformer(v, v, [contract.Term("a", "missing")])
    with pytest.raises(KeyError):
        contract.setup("climate", "nothing")
    assert contract.constant({"lhm": (334.0, "kJ")}, "lhm", "J") == 334000.0


def test_fortran_round_trip(spark, tmp_path):
    values = np.arange(2 * 4 * 4, dtype=">f4").reshape(4, 8)
    rec = b"ZATMO: Surface height (m)  ETOPO".ljust(80) + values.tobytes()
    (tmp_path / "x.bin").write_bytes(fortran.write_record(rec) + fortran.write_record(rec))
    df = fortran.read_titled(spark, f"file://{tmp_path}/x.bin")
    assert df.count() == 64 and df.filter("j = 2 and i = 3 and record = 1").first()["value"] == 19.0
    got = df.select(*fortran.title_columns(F.col("title"))).first()
    assert tuple(got) == ("ZATMO", "Surface height", "m", "ETOPO") == fortran.parse_title("ZATMO: Surface height (m)  ETOPO")
    (tmp_path / "y.bin").write_bytes(b"".join(fortran.write_record(np.full(8, k, ">i2").tobytes()) for k in range(3)))
    raw = fortran.read_untitled(spark, f"file://{tmp_path}/y.bin", 4, 2, ["a", "b", "c"])
    assert raw.agg(F.sum("b"), F.sum("c"), F.count("*")).first() == (8.0, 16.0, 8)
    with pytest.raises(ValueError):
        list(fortran.records(struct.pack(">i", 8) + b"12"))


def test_tables(spark, tmp_path):
    m = spark.createDataFrame([(0, 1, 2.0)], "row long, col long, val double")
    w = coo.WeightedMatrix(m, coo.sums(m), coo.sums(m, "col"), False, True)
    tables.write_matrix(w, f"file://{tmp_path}/m", "AvI")
    back = tables.read_matrix(spark, f"file://{tmp_path}/m", "AvI")
    assert not back.conservative and back.scaled and [tuple(r) for r in back.Mw.collect()] == [(1, 2.0)]
    spark.createDataFrame([(0, 1, 2, 5.0, 1.0), (1, 1, 4, 5.0, 1.0), (1, 2, 0, 7.0, 0.0)], "time int, i_id long, mask int, topg double, thk double").write.parquet(f"file://{tmp_path}/pism")
    assert [tuple(r) for r in tables.read_elevmask(spark, f"pism:file://{tmp_path}/pism").collect()] == [("land", 2, 7.0)]
    with pytest.raises(ValueError):
        tables.read_elevmask(spark, "other:x")
