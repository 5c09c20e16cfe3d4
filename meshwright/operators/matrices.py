"""The regridding matrices between atmosphere (A), elevation classes (E), ice (I) and exchange (X) grids.

For cells of constant value all of them are one GROUP BY over one fact table:
``f(a, i, x, area)``, the exchange cells that are not masked, and ``g``, the same
with the weights of elevation classes. The exchange table is joined to the mask
once and never to itself; reverse matrices are transposes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grids import RegridParams
from . import coo, elevation
from .coo import WeightedMatrix

SPECS = ("AvI", "IvA", "AvX", "XvA", "EvI", "IvE", "EvX", "XvE", "EvA", "AvE")


class SheetMatrices:
    """The matrices of one ice sheet, built on demand.

    ``exchange (x_id, a_id, i_id, area)``, ``elevmask (i_id, elev)`` without the
    masked cells, ``areas (a_id, native_area, proj_area)``. Class cells have the
    key ``ihc * n_a + a_id``. ``style`` is ``z`` (two height points) or ``class``
    (the nearest).
    """

    def __init__(self, exchange: DataFrame, elevmask: DataFrame, areas: DataFrame, hcdefs: list[float], n_a: int, style: str = "z", params: RegridParams | None = None) -> None:
        if style not in ("z", "class"):
            raise ValueError(f"unknown interpolation style {style}")
        self.n_a, self.hcdefs, self.params = n_a, hcdefs, params or RegridParams()
        self.areas = areas
        # a mask of all cells grows with the grid, and files say little of its size in memory: it is never broadcast
        facts = exchange.filter("area > 0").join(elevmask.select("i_id", "elev").hint("merge"), "i_id")
        self.f = facts.select(F.col("x_id").cast("long").alias("X"), F.col("a_id").cast("long").alias("A"), F.col("i_id").cast("long").alias("I"), F.col("area"), F.greatest(F.col("elev"), F.lit(0.0)).alias("elev"))
        classed = (elevation.bracket if style == "z" else elevation.nearest)(self.f, hcdefs)
        self.g = classed.select("X", "A", "I", (F.col("ihc").cast("long") * n_a + F.col("A")).alias("E"), (F.col("area") * F.col("w")).alias("area"))

    def store(self, path: str) -> SheetMatrices:
        """Write both fact tables, and build all matrices from them: exchange, mask and classes are then joined once only."""
        spark = self.f.sparkSession
        for name in ("f", "g"):
            df = getattr(self, name)
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
            setattr(self, name, spark.read.schema(df.schema).parquet(f"{path}/{name}"))
        return self

    def ur(self, spec: str) -> DataFrame:
        """The unscaled entries ``(row, col, val)`` of a matrix, before any correction."""
        b, a = spec.split("v")
        facts = self.g if "E" in (a, b) else self.f
        return facts.groupBy(F.col(b).alias("row"), F.col(a).alias("col")).agg(F.sum("area").alias("val"))

    def _p(self, letter: str, axis: str) -> DataFrame:
        """native / projected area of the A cell behind each A or E key."""
        p = self.areas.select(F.col("a_id").cast("long").alias("a"), F.try_divide("native_area", "proj_area").alias("p"))
        return p.select(F.col("a").alias(axis), "p")

    def _corrected(self, m: DataFrame, letter: str, axis: str, value: str = "val") -> DataFrame:
        p = self._p(letter, "pa")
        return m.withColumn("pa", F.pmod(F.col(axis), F.lit(self.n_a))).join(p, "pa").withColumn(value, F.col(value) * F.col("p")).drop("p", "pa")

    def matrix(self, spec: str, params: RegridParams | None = None) -> WeightedMatrix:
        """A matrix with its weights.

        With ``correct_a`` the weights of A and E cells are in their native area. The
        unscaled matrix from I or X to them stays as it is, uncorrected.
        """
        if spec not in SPECS:
            raise KeyError(f"no matrix {spec}; there are {', '.join(SPECS)}")
        params = params or self.params
        b, a = spec.split("v")
        u = self.ur(spec)
        ae = "AE"
        wm, mw = coo.sums(u, "row"), coo.sums(u, "col")
        m = u
        if b in ae and a in ae:
            if params.correct_a:
                wm, mw = self._corrected(wm, b, "idx", "w"), self._corrected(mw, a, "idx", "w")
                m = self._corrected(u, a, "col")
            if params.scale:
                m = coo.scale(m, wm, "row", invert=True)
        elif b in ae:
            if params.scale:
                m = coo.scale(u, wm, "row", invert=True)
                if params.correct_a:
                    m = self._uncorrected(m, b, "row")
            if params.correct_a:
                wm = self._corrected(wm, b, "idx", "w")
        else:
            if params.correct_a:
                m, mw = self._corrected(u, a, "col"), self._corrected(mw, a, "idx", "w")
            if params.scale:
                m = coo.scale(m, wm, "row", invert=True)
        return WeightedMatrix(m.select("row", "col", "val"), wm.select("idx", "w"), mw.select("idx", "w"), True, params.scale)

    def _uncorrected(self, m: DataFrame, letter: str, axis: str) -> DataFrame:
        p = self._p(letter, "pa")
        return m.withColumn("pa", F.pmod(F.col(axis), F.lit(self.n_a))).join(p, "pa").withColumn("val", F.try_divide("val", "p")).drop("p", "pa")

    def smoothed(self, spec: str, smoother: DataFrame, params: RegridParams | None = None) -> WeightedMatrix:
        """A matrix to I, smoothed over I after scaling; it no longer conserves."""
        w = self.matrix(spec, params)
        if not spec.startswith("I"):
            raise ValueError("only matrices to the ice grid are smoothed")
        return WeightedMatrix(coo.multiply_blocks(smoother, w.M), w.wM, w.Mw, False, w.scaled)


def class_areas(m: SheetMatrices) -> DataFrame:
    """``(idx, w)``: the area of every class cell."""
    return m.g.groupBy(F.col("E").alias("idx")).agg(F.sum("area").alias("w"))


def atmosphere_weights(areas: DataFrame, projected: bool = False) -> DataFrame:
    return areas.select(F.col("a_id").cast("long").alias("idx"), F.col("proj_area" if projected else "native_area").alias("w"))
