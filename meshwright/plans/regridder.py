"""The regridder: an atmosphere grid, its elevation classes and any number of ice sheets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import HntrSpec, Indexing, RegridParams, elevation_indexing
from ..functions.projection import PolarStereographic
from ..operators import coo, merging, ocean
from ..operators.coo import WeightedMatrix
from ..operators.matrices import SPECS, SheetMatrices, atmosphere_weights
from ..operators.overlap_ll import overlap_matrix
from ..operators.smoothing import smoothing_matrix


@dataclass
class Sheet:
    exchange: DataFrame
    ice_cells: DataFrame | None = None
    proj_areas: DataFrame | None = None
    style: str = "z"


@dataclass
class Regridder:
    """``areas (a_id, native_area)`` of the atmosphere grid; ``hcdefs`` ascending elevations."""

    spark: SparkSession
    areas: DataFrame
    n_a: int
    hcdefs: list[float]
    correct_a: bool = True
    sheets: dict[str, Sheet] = field(default_factory=dict)

    @property
    def nhc(self) -> int:
        return len(self.hcdefs)

    @property
    def n_e(self) -> int:
        return self.n_a * self.nhc

    @property
    def indexing_e(self) -> Indexing:
        return elevation_indexing(Indexing(("A",), (0,), (self.n_a,), (0,)), self.nhc)

    def add_sheet(self, name: str, exchange: DataFrame, ice_cells: DataFrame | None = None, proj_areas: DataFrame | None = None, style: str = "z", parameterization: str = "L0") -> Sheet:
        """``exchange (x_id, a_id, i_id, area)``; without ``proj_areas (a_id, proj_area)`` the ice grid is on the sphere and areas are native."""
        if parameterization != "L0":
            raise ValueError("sheets have values constant in each cell")
        if name in self.sheets:
            raise ValueError(f"sheet {name} is there already")
        self.sheets[name] = Sheet(exchange, ice_cells, proj_areas, style)
        return self.sheets[name]

    def sheet_areas(self, name: str) -> DataFrame:
        s = self.sheets[name]
        if s.proj_areas is None:
            return self.areas.select("a_id", "native_area", F.col("native_area").alias("proj_area"))
        return self.areas.join(s.proj_areas, "a_id").select("a_id", "native_area", "proj_area")

    def weights(self, name: str | None = None, native: bool = True, fill: float | None = None) -> DataFrame:
        """``(idx, w)`` of the A cells, native or as the sheet's projection has them; with ``fill`` for all cells."""
        w = atmosphere_weights(self.areas.withColumn("proj_area", F.col("native_area")) if native or name is None else self.sheet_areas(name), not native)
        if fill is None:
            return w
        return self.spark.range(self.n_a).withColumnRenamed("id", "idx").join(w, "idx", "left").fillna(float(fill), ["w"])

    def regrid_matrices(self, name: str, elevmask: DataFrame, params: RegridParams | None = None) -> SheetRegistry:
        s = self.sheets[name]
        params = params or RegridParams(True, self.correct_a)
        return SheetRegistry(SheetMatrices(s.exchange, elevmask, self.sheet_areas(name), self.hcdefs, self.n_a, s.style, params), s.ice_cells, params)

    def filtered(self, keep_a: DataFrame) -> Regridder:
        """The regridder of a domain: only its A cells (``a_id``), the exchange cells on them and the ice cells that these touch."""
        out = Regridder(self.spark, self.areas.join(keep_a, "a_id", "left_semi"), self.n_a, self.hcdefs, self.correct_a)
        for n, s in self.sheets.items():
            x = s.exchange.join(keep_a, "a_id", "left_semi")
            cells = None if s.ice_cells is None else s.ice_cells.join(x.select(F.col("i_id").alias("cell_id")).distinct(), "cell_id", "left_semi")
            out.sheets[n] = Sheet(x, cells, s.proj_areas, s.style)
        return out

    def union_matrix(self, spec: str, elevmasks: dict[str, DataFrame], params: RegridParams | None = None) -> DataFrame:
        """``(sheet, row, col, val)`` of all sheets."""
        out = None
        for n, mask in elevmasks.items():
            part = self.regrid_matrices(n, mask, params).matrix(spec).M.select(F.lit(n).alias("sheet"), "row", "col", "val")
            out = part if out is None else out.unionByName(part)
        return out

    def save(self, path: str) -> None:
        """Everything that the regridder is made of; ``load`` gives it back."""
        self.areas.write.mode("overwrite").parquet(f"{path}/areas")
        head = [(self.n_a, list(map(float, self.hcdefs)), self.correct_a)]
        self.spark.createDataFrame(head, "n_a long, hcdefs array<double>, correct_a boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
        about = [(n, s.style, s.ice_cells is not None, s.proj_areas is not None) for n, s in self.sheets.items()]
        self.spark.createDataFrame(about, "sheet string, style string, has_cells boolean, has_areas boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/sheets")
        for n, s in self.sheets.items():
            for kind, df in (("exchange", s.exchange), ("ice_cells", s.ice_cells), ("proj_areas", s.proj_areas)):
                if df is not None:
                    df.write.mode("overwrite").parquet(f"{path}/{kind}/sheet={n}")

    @staticmethod
    def load(spark: SparkSession, path: str, sheets: list[str] | None = None) -> Regridder:
        """What ``save`` wrote, with all sheets or those named."""
        head = spark.read.parquet(f"{path}/head").first()
        out = Regridder(spark, spark.read.parquet(f"{path}/areas"), head["n_a"], list(head["hcdefs"]), head["correct_a"])
        about = {r["sheet"]: r for r in spark.read.parquet(f"{path}/sheets").orderBy("sheet").collect()}
        for n in about if sheets is None else sheets:
            part = lambda kind, there: spark.read.parquet(f"{path}/{kind}/sheet={n}") if there else None  # noqa: B023, E731
            out.add_sheet(n, part("exchange", True), part("ice_cells", about[n]["has_cells"]), part("proj_areas", about[n]["has_areas"]), about[n]["style"])
        return out


@dataclass
class SheetRegistry:
    """Matrices by name; nothing is computed before an action."""

    matrices: SheetMatrices
    ice_cells: DataFrame | None
    params: RegridParams

    @property
    def names(self) -> tuple[str, ...]:
        return SPECS

    def matrix(self, spec: str, params: RegridParams | None = None) -> WeightedMatrix:
        params = params or self.params
        if spec[0] == "I" and params.smooth:
            if self.ice_cells is None:
                raise ValueError("smoothing needs the ice cells' centres")
            z = self.matrices.f.select(F.col("I").alias("idx"), F.col("elev").alias("z")).distinct()
            pts = self.ice_cells.select(F.col("cell_id").alias("idx"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("native_area").alias("area")).join(z, "idx")
            return self.matrices.smoothed(spec, smoothing_matrix(pts, params.sigma), params)
        return self.matrices.matrix(spec, params)


def projected_areas(cells: DataFrame, sproj: str) -> DataFrame:
    """``(a_id, proj_area)`` of lon/lat cells on a projected plane."""
    p = PolarStereographic.parse(sproj)
    v = cells.select("cell_id", F.posexplode("ring").alias("k", "v"))
    x, y = p.forward(F.col("v.x"), F.col("v.y"))
    pts = v.select("cell_id", "k", x.alias("x"), y.alias("y")).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("r"))
    from ..functions.geometry import shoelace

    ring = F.transform("r", lambda q: F.struct(F.lit(None).cast("long").alias("vid"), q["x"].alias("x"), q["y"].alias("y")))
    return pts.select(F.col("cell_id").alias("a_id"), F.abs(shoelace(ring)).alias("proj_area"))


@dataclass
class MismatchedRegridder:
    """A regridder of the ocean grid seen from the atmosphere grid of twice the cell size, with two ocean masks.

    ``focean (idx, focean_p, focean_m)``: as the ice model and as the climate model
    sees the ocean. The caller's correction of areas is ignored, as it always is here.
    """

    base: Regridder
    ocean: HntrSpec
    focean: DataFrame

    @property
    def atmosphere(self) -> HntrSpec:
        return self.ocean.halved()

    def ocean_from_atmosphere(self) -> DataFrame:
        """``(row, col, val)``: areas shared by ocean and atmosphere cells."""
        return overlap_matrix(self.base.spark, self.ocean, self.atmosphere)

    def matrix(self, name: str, spec: str, elevmask: DataFrame, scale: bool = True) -> WeightedMatrix:
        """AvI, IvA, EvI, IvE, AvX, XvA, EvX, XvE, EvA, AvE of the atmosphere grid, AOmvAAm or AAmvAOm.

        EAmvIp, AAmvIp, IpvEAm and IpvAAm are long names of EvI, AvI, IvE and IvA.
        """
        spec = {"EAmvIp": "EvI", "AAmvIp": "AvI", "IpvEAm": "IvE", "IpvAAm": "IvA"}.get(spec, spec)
        if spec in ("AOmvAAm", "AAmvAOm"):
            m = self.ocean_from_atmosphere()
            m = m if spec == "AOmvAAm" else coo.transpose(m)
            return self._weighted(m, scale)
        if spec in ("EvA", "AvE"):
            e = self._cells(name, "E", elevmask, "X")
            ihc_a = F.pmod("row", F.lit(self.atmosphere.size))
            m = coo.consolidate(e.select("row", ihc_a.alias("col"), "val"))
            return self._weighted(m if spec == "EvA" else coo.transpose(m), scale)
        b, a = spec.split("v")
        ae, other = (b, a) if b in "AE" else (a, b)
        m = self._cells(name, ae, elevmask, other)
        return self._weighted(m if b == ae else coo.transpose(m), scale)

    def _cells(self, name: str, ae: str, elevmask: DataFrame, other: str) -> DataFrame:
        """Areas shared by A or E cells of the atmosphere and I or X cells, on the continents of the masked grid."""
        u = self.base.regrid_matrices(name, elevmask, RegridParams(False, False)).matrices.ur(f"{ae}v{other}")
        o = F.pmod("row", F.lit(self.ocean.size))
        on = u.withColumn("o", o).join(ocean.ocean_scale(self.focean).withColumnRenamed("idx", "o"), "o")
        pairs = overlap_matrix(self.base.spark, self.atmosphere, self.ocean, scaled=True).select(F.col("row").alias("a"), F.col("col").alias("o"))
        key = F.floor((F.col("row") - F.col("o")) / self.ocean.size).cast("long") * self.atmosphere.size + F.col("a")
        return coo.consolidate(on.join(pairs, "o").select(key.alias("row"), "col", (F.col("val") * F.col("w")).alias("val")))

    @staticmethod
    def _weighted(m: DataFrame, scale: bool) -> WeightedMatrix:
        wm, mw = coo.sums(m, "row"), coo.sums(m, "col")
        return WeightedMatrix(coo.scale(m, wm, "row", invert=True) if scale else m, wm, mw, True, scale)


def global_classes(ice: DataFrame, fine: HntrSpec, ocean_grid: HntrSpec, hcdefs: list[float], style: str = "z", path: str | None = None) -> dict[str, WeightedMatrix]:
    """All matrices of a global raster of ice, ``(idx, elev)`` on the fine grid, in one plan.

    The fine grid must nest in the ocean grid, so the exchange is an integer
    division. What takes chunks and a merge of their files elsewhere is one partial
    and final aggregation here. With a ``path`` the facts are stored there once, for
    those who read several of the ten matrices.
    """
    from ..operators.overlap_ll import nested_parent

    spark = ice.sparkSession
    j = F.floor(F.col("idx") / fine.im)
    import math

    dlat = math.pi / fine.jm
    area = (F.sin((j + 1 - fine.jm / 2) * dlat) - F.sin((j - fine.jm / 2) * dlat)) * (2 * math.pi / fine.im)
    x = ice.select(F.col("idx").alias("x_id"), nested_parent(F.col("idx"), fine, ocean_grid).alias("a_id"), F.col("idx").alias("i_id"), area.alias("area"))
    row = F.floor(F.col("id") / ocean_grid.im)
    do = math.pi / ocean_grid.jm
    native = (F.sin((row + 1 - ocean_grid.jm / 2) * do) - F.sin((row - ocean_grid.jm / 2) * do)) * (2 * math.pi / ocean_grid.im)
    areas = spark.range(ocean_grid.size).select(F.col("id").alias("a_id"), native.alias("native_area"), native.alias("proj_area"))
    m = SheetMatrices(x, ice.select(F.col("idx").alias("i_id"), "elev"), areas, hcdefs, ocean_grid.size, style, RegridParams(True, False))
    if path is not None:
        m.store(path)
    return {s: m.matrix(s) for s in SPECS}


def on_display_grid(i_v_x: WeightedMatrix, display_v_i: DataFrame) -> WeightedMatrix:
    """A matrix to the ice grid as one to a grid for display, unscaled.

    ``display_v_i (row, col, val)``: areas that display and ice cells share, of ice
    cells that are not masked. An ice cell's weight is divided among the display
    cells by area.
    """
    share = coo.scale(display_v_i, coo.sums(display_v_i, "col"), "col", invert=True)
    w = coo.scale(share, i_v_x.wM, "col")
    m = coo.multiply(coo.scale(display_v_i, i_v_x.wM, "col", invert=True), i_v_x.M)
    return WeightedMatrix(m, coo.sums(w, "row"), i_v_x.Mw, i_v_x.conservative, False)


def display_overlap(elevmask: DataFrame, fine: HntrSpec, display: HntrSpec) -> DataFrame:
    """``(row, col, val)``: areas shared by a coarser display grid and the unmasked cells ``(i_id, elev)`` of a fine one."""
    return coo.crop(overlap_matrix(elevmask.sparkSession, display, fine), elevmask.select(F.col("i_id").alias("idx")), "col")


def merged_a_v_e(local: DataFrame, everywhere: DataFrame, hc_local: list[float], hc_global: list[float], focean: DataFrame, o_grid: HntrSpec, a_grid: HntrSpec, areas: DataFrame, squash: bool = False) -> tuple[DataFrame, DataFrame]:
    """A <- E on the atmosphere grid from local and global E <- O matrices of the fractional ocean grid, with the table of classes."""
    e_v_o, hc = merged_classes(local, everywhere, hc_local, hc_global, o_grid.size, squash)
    return ocean.atmosphere_from_ocean_classes(e_v_o, focean, o_grid, a_grid, areas), hc


def merged_classes(local: DataFrame, everywhere: DataFrame, hc_local: list[float], hc_global: list[float], n_a: int, squash: bool = False, axis: str = "row") -> tuple[DataFrame, DataFrame]:
    """Local and global class matrices as one, with the table of all classes; ``squash`` joins classes of equal elevation."""
    from ..operators.topo import UI_GLOBALICE, UI_LOCALICE

    spark = local.sparkSession
    rows = [(k, float(h), UI_LOCALICE) for k, h in enumerate(hc_local)] + [(len(hc_local) + k, float(h), UI_GLOBALICE) for k, h in enumerate(hc_global)]
    hc = spark.createDataFrame(rows, "ihc int, elev double, underice int")
    m = merging.stack_classes(local, everywhere, len(hc_local), n_a, axis)
    return merging.squash_classes(m, hc, n_a, axis) if squash else (m, hc)
