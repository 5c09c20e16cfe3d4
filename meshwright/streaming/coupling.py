"""The coupling loop: a deterministic function of (state, batch), and its replay from a directory of batches.

The state between steps is three tables: the matrix from elevation classes to
ice cells for the next inputs, the class matrix of the exchange grid for the
change of classes, and the ice model's own state. Each step writes them before
the next begins, so lineage never grows and a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import RegridParams
from ..operators import coo, topo
from ..operators.matrices import SheetMatrices
from ..plans.regridder import SheetRegistry
from .contract import Transformer

#: An ice model: (state, inputs on I or None before the first step, seconds of the step) to (state, outputs on I).
IceModel = Callable[[DataFrame | None, DataFrame | None, float], tuple[DataFrame, DataFrame]]


def class_change(x_u_e1: DataFrame, x_u_e0: DataFrame) -> DataFrame:
    """``(row, col, val)``: how values move between elevation classes from one step to the next, less the identity.

    ``x_u_e (row, col, val)``: areas shared by exchange and class cells at the end and
    at the beginning of the step. The result is E1 <- X times the difference of the
    two X <- E matrices, its rows scaled by the new class areas.
    """
    share = lambda m: coo.scale(m, coo.sums(m, "row"), "row", invert=True)
    diff = share(x_u_e0).unionAll(share(x_u_e1).withColumn("val", -F.col("val")))
    diff = coo.consolidate(diff)
    raw = coo.multiply(coo.transpose(x_u_e1), diff)
    return coo.scale(raw, coo.sums(x_u_e1, "col"), "row", invert=True)


def regrid_values(m: DataFrame, values: DataFrame, names: list[str], key: str = "idx") -> DataFrame:
    """Matrix times several vectors at once: ``(idx, *names)``; absent cells have no value."""
    x = m.join(values.withColumnRenamed(key, "col"), "col")
    return x.groupBy(F.col("row").alias("idx")).agg(*(F.sum(F.col("val") * F.col(n)).alias(n) for n in names))


def owner(idx, im: int, jm: int, ranks: int):
    """Which of ``ranks`` bands of latitude owns a cell."""
    j = F.pmod(F.floor(idx / im), F.lit(jm))
    return F.floor(j * ranks / jm).cast("int")


def to_ice(i_v_e: DataFrame, gcm_out: DataFrame, there: Transformer, scalars: dict[str, float | None]) -> DataFrame:
    """Inputs of the ice model: the contract's combinations of the class values, regridded. Repeated class rows are weighted means."""
    names = there.inputs.names
    dense = gcm_out.groupBy("idx").agg(*(F.try_divide(F.sum(n), F.sum("weight")).alias(n) for n in names))
    return regrid_values(i_v_e, there.select(dense, "idx", scalars=scalars), there.outputs.names)


def to_gcm(e_u_i: coo.WeightedMatrix, ice_out: DataFrame, back: Transformer, scalars: dict[str, float | None]) -> DataFrame:
    """Outputs of the ice model on A or E: sums of value times area and the area as ``weight``, to be added up over sheets."""
    values = regrid_values(e_u_i.M, back.select(ice_out, "idx", scalars=scalars), back.outputs.names)
    return values.join(e_u_i.wM.withColumnRenamed("w", "weight"), "idx").select("idx", "weight", *back.outputs.names)


def apply_to_model(current: DataFrame, update: DataFrame, names: list[str]) -> DataFrame:
    """``(idx, *names)`` with the cells that an update ``(idx, weight, *names)`` touches replaced by its weighted means."""
    new = update.groupBy("idx").agg(*(F.try_divide(F.sum(n), F.sum("weight")).alias(f"new_{n}") for n in names)).withColumn("hit", F.lit(True))
    x = current.join(new, "idx", "full")
    return x.select("idx", *(F.when(F.col("hit"), F.col(f"new_{n}")).otherwise(F.col(n)).alias(n) for n in names))


def emit_merged(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """Cells that are merged now, or were after the last step: ``(idx, mask, ...)`` of now."""
    if before is None:
        return now.filter("mask <> 0")
    old = before.select("idx", F.col("mask").alias("old"))
    return now.join(old, "idx", "full").filter("coalesce(mask, 0) <> 0 or coalesce(old, 0) <> 0").drop("old")


@dataclass
class Sheet:
    """One ice sheet in the loop; a positive ``sigma`` smooths what the ice model gets, over ``ice_cells (cell_id, cx, cy, native_area)``."""

    name: str
    exchange: DataFrame
    areas: DataFrame
    hcdefs: list[float]
    n_a: int
    model: IceModel
    there: Transformer
    back: Transformer
    elevation: str = "elev"
    sigma: tuple[float, float, float] = (0.0, 0.0, 0.0)
    ice_cells: DataFrame | None = None
    style: str = "z"


@dataclass
class Coupler:
    """Runs sheets step by step; ``path`` is a shared folder for state, inputs and outputs.

    A step counts once its mark is written, after everything else. Until then the
    coupler stands at the step before, so a step that failed is simply run again.
    """

    spark: SparkSession
    sheets: list[Sheet]
    path: str
    time: float | None = None
    step: int = -1
    _state: dict[tuple[str, str], DataFrame] = field(default_factory=dict)

    def _write(self, df: DataFrame, where: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{where}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{where}")

    def written(self, step: int) -> float | None:
        """The time of a step that was written to its end, else None."""
        try:
            row = self.spark.read.parquet(f"{self.path}/steps/step={step}").first()
        except AnalysisException:
            return None
        return row["time"] if row else None

    def restore(self, step: int, time: float | None = None) -> None:
        """Go on after a step that was written."""
        if time is None:
            time = self.written(step)
            if time is None:
                raise ValueError(f"step {step} was not written to its end")
        self.step, self.time = step, time
        for s in self.sheets:
            for kind in ("IvE", "XuE", "ice"):
                self._state[s.name, kind] = self.spark.read.parquet(f"{self.path}/state/step={step}/sheet={s.name}/{kind}")

    def couple(self, time: float, gcm_out: DataFrame | None = None) -> dict[str, DataFrame]:
        """One step up to ``time`` (s): ``E`` and ``A`` values with weights and, after the first step, ``E1vE0``.

        The first call only initialises: the ice does not run, and rates over the
        step, which has no length, are null. Running a step again from the same state
        and batch writes the same tables.
        """
        first = self.time is None
        dt = 0.0 if first else time - self.time
        if not first and dt <= 0:
            raise ValueError("time must advance")
        step = self.step + 1
        scalars = {"by_dt": None if first else 1 / dt}
        state: dict[tuple[str, str], DataFrame] = {}
        parts: dict[str, list[DataFrame]] = {"E": [], "A": [], "E1vE0": []}
        for s in self.sheets:

            def keep(kind: str, df: DataFrame, s: Sheet = s) -> DataFrame:
                state[s.name, kind] = out = self._write(df, f"state/step={step}/sheet={s.name}/{kind}")
                return out

            inputs = None if first or gcm_out is None else to_ice(self._state[s.name, "IvE"], gcm_out, s.there, scalars)
            ice, outputs = s.model(self._state.get((s.name, "ice")), inputs, dt)
            keep("ice", ice)
            outputs = keep("outputs", outputs)
            elev = outputs.select(F.col("idx").alias("i_id"), F.col(s.elevation).alias("elev")).filter("elev is not null")
            m = SheetMatrices(s.exchange, elev, s.areas, s.hcdefs, s.n_a, s.style).store(f"{self.path}/facts/step={step}/sheet={s.name}")
            raw, corrected = RegridParams(False, False), RegridParams(False, True)
            parts["E"].append(to_gcm(m.matrix("EvI", raw), outputs, s.back, scalars))
            parts["A"].append(to_gcm(m.matrix("AvI", corrected), outputs, s.back, scalars))
            old = self._state.get((s.name, "XuE"))
            keep("IvE", SheetRegistry(m, s.ice_cells, RegridParams(True, True, s.sigma)).matrix("IvE").M)
            new = keep("XuE", m.ur("XvE"))
            if not first and old is not None:
                parts["E1vE0"].append(class_change(new, old))
        out = {k: self._write(reduce(DataFrame.unionByName, dfs), f"gcm_in/kind={k}/step={step}") for k, dfs in parts.items() if dfs}
        self._write(self.spark.createDataFrame([(step, float(time))], "step long, time double").coalesce(1), f"steps/step={step}")
        self.step, self.time = step, time
        self._state |= state
        return out

    def replay(self, batches: str, schema, checkpoint: str) -> None:
        """Run all batches of a directory, ``(step, time, idx, weight, ...)``, one file a step, through Structured Streaming.

        A batch that comes again after a failure is run again from the state before
        its own step, also by a new coupler over the same path.
        """
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(batches)

        def run(batch: DataFrame, _: int) -> None:
            row = batch.agg(F.max("time").alias("time"), F.max("step").alias("step")).first()
            if row["step"] is None:
                return
            if row["step"] != self.step + 1:
                self.restore(row["step"] - 1)
            self.couple(float(row["time"]), batch)

        stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@dataclass
class Topography:
    """The climate model's topography, renewed from the ice sheets after every step.

    ``base (idx, area, focean_p, ...)`` is ocean-grid topography without the sheets, as
    ``topo.merge_sheets`` takes it. The ocean mask that the climate model sees is that
    of the first update and never changes; the fractional one does.
    """

    base: DataFrame
    focean_m: DataFrame | None = None

    def update(self, deltas: list[DataFrame], im: int, jm: int) -> DataFrame:
        """Ocean-grid topography with the sheets' ``topo.sheet_deltas`` in it, and single ocean cells between land made land."""
        sheets = reduce(DataFrame.unionByName, deltas).select("idx", "da_cont", "da_ice", "da_zatmo", "da_zicetop")
        merged = topo.merge_sheets(self.base, sheets)
        cells = merged.withColumns({"j": F.expr(f"cast(idx div {im} as int)"), "i": F.pmod("idx", F.lit(im)).cast("int"), **{f"_{c}": F.col(c) for c in ("fgice_m", "fgrnd_m", "zatmo_m")}})
        out = topo.neighbour_ocean(cells, im, jm)
        out = out.withColumns({c: F.coalesce(c, f"_{c}") for c in ("fgice_m", "fgrnd_m", "zatmo_m")}).drop("_fgice_m", "_fgrnd_m", "_zatmo_m", "changed", "j", "i")
        if self.focean_m is None:
            return out
        return out.drop("focean_m").join(self.focean_m, "idx")

    def freeze(self, updated: DataFrame) -> None:
        """Keep the ocean mask ``(idx, focean_m)`` of a written first update."""
        if self.focean_m is None:
            self.focean_m = updated.select("idx", "focean_m")


def changed_topography(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """The cells that go to the climate model: those merged with ice sheets now, or after the step before."""
    return emit_merged(now.withColumn("mask", F.col("mergemask")), None if before is None else before.select("idx", F.col("mergemask").alias("mask"))).drop("mask")


def command_line(start: list[str], settings: dict[str, str], overrides: dict[str, str] | None = None) -> list[str]:
    """The arguments of an external ice model: each setting as ``-name value``, replaced by what overrides it."""
    overrides = overrides or {}
    return [*start, *(word for name, value in settings.items() for word in (f"-{name}", overrides.get(name, value)))]


#: Ice models by name, each a function of its settings.
ICE_MODELS: dict[str, Callable[..., IceModel]] = {}


def ice_model(name: str, **settings) -> IceModel:
    """An ice model of a registered kind; others raise."""
    if name not in ICE_MODELS:
        raise ValueError(f"no ice model {name!r}; there are {', '.join(sorted(ICE_MODELS)) or 'none'}")
    return ICE_MODELS[name](**settings)


def echo_model(elevation: DataFrame) -> IceModel:
    """A stand-in for an ice model: it adds up what it gets and holds its elevation ``(idx, elev)``."""

    def run(state: DataFrame | None, inputs: DataFrame | None, dt: float) -> tuple[DataFrame, DataFrame]:
        zero = elevation.select("idx", "elev", F.lit(0.0).alias("mass"), F.lit(0.0).alias("enth"))
        state = zero if state is None else state
        if inputs is None:
            return state, state
        add = inputs.select("idx", (F.coalesce("massxfer", F.lit(0.0)) * dt).alias("dm"), (F.coalesce("enthxfer", F.lit(0.0)) * dt).alias("dh"))
        x = state.join(add, "idx", "left")
        new = x.select("idx", "elev", (F.col("mass") + F.coalesce("dm", F.lit(0.0))).alias("mass"), (F.col("enth") + F.coalesce("dh", F.lit(0.0))).alias("enth"))
        return new, new

    return run


ICE_MODELS["echo"] = echo_model
