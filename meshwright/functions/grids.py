"""Grid descriptions: regular longitude/latitude grids, boundary grids, planar grids."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class HntrSpec:
    """A regular grid around the globe: ``im`` x ``jm`` cells of ``dlat`` minutes, ``offi`` cells east of the date line."""

    im: int
    jm: int
    offi: float = 0.0
    dlat: float = 0.0

    def __post_init__(self) -> None:
        if self.im <= 0 or self.jm <= 0:
            raise ValueError("a grid needs cells")
        if not self.dlat:
            object.__setattr__(self, "dlat", 180 * 60 / self.jm)

    @property
    def size(self) -> int:
        return self.im * self.jm

    def edge_sin(self, j: int) -> float:
        """Sine of the latitude of the edge below row ``j`` (0-based); the outermost edges are the poles."""
        if j <= 0:
            return -1.0
        if j >= self.jm:
            return 1.0
        return math.sin((j - self.jm / 2) * self.dlat * math.pi / 10800)

    def row_area(self, j: int) -> float:
        """Area of a cell of row ``j`` (0-based) on the unit sphere, for odd ``jm`` too."""
        dlat = math.pi / self.jm
        return 2 * math.pi / self.im * (math.sin(dlat * (j + 1 - self.jm / 2)) - math.sin(dlat * (j - self.jm / 2)))

    def lon_center(self, i: int) -> float:
        return -180 + 360 / self.im * (i + self.offi + 0.5)

    def lat_center(self, j: int) -> float:
        return (j + 0.5 - self.jm / 2) * self.dlat / 60

    def halved(self) -> HntrSpec:
        """The grid of half as many cells each way."""
        if self.im % 2 or self.jm % 2:
            raise ValueError("only an even grid can be halved")
        return HntrSpec(self.im // 2, self.jm // 2, self.offi / 2, self.dlat * 2)


def from_degrees_minutes(im: int, jm: int, degrees: int, minutes: int) -> HntrSpec:
    """A grid whose row height is stated in degrees and minutes, which must agree with ``jm``."""
    dlat = degrees * 60 + minutes
    if dlat <= 0 or abs(dlat * jm - 10800) > dlat:
        raise ValueError(f"{jm} rows of {dlat} minutes do not reach from pole to pole")
    return HntrSpec(im, jm, 0.0, float(dlat))


# The named grids, as columns, rows, offset and minutes a row.
NAMED = {
    "g1mx1m": HntrSpec(21600, 10800, 0.0, 1.0),
    "g2mx2m": HntrSpec(10800, 5400, 0.0, 2.0),
    "g10mx10m": HntrSpec(2160, 1080, 0.0, 10.0),
    "ghxh": HntrSpec(720, 360, 0.0, 30.0),
    "g1x1": HntrSpec(360, 180, 0.0, 60.0),
    "g1qx1": HntrSpec(288, 180, 0.0, 60.0),
    "g2hx2": HntrSpec(144, 90, 0.0, 120.0),
    "g5x4": HntrSpec(72, 45, 0.0, 240.0),
}


@dataclass(frozen=True)
class LonLatSpec:
    """Cells between stated boundaries; optional polar caps; ``points_in_side`` segments an edge."""

    lonb: tuple[float, ...]
    latb: tuple[float, ...]
    south_pole: bool = False
    north_pole: bool = False
    points_in_side: int = 1
    eq_rad: float = 1.0

    def __post_init__(self) -> None:
        if len(self.lonb) < 2 or len(self.latb) < 2 - self.south_pole - self.north_pole:
            raise ValueError("a grid needs boundaries")
        if list(self.lonb) != sorted(set(self.lonb)) or list(self.latb) != sorted(set(self.latb)):
            raise ValueError("boundaries must ascend")
        if self.south_pole and self.latb[0] <= -90 or self.north_pole and self.latb[-1] >= 90:
            raise ValueError("a grid with a polar cap can't have a boundary at its pole")
        if self.points_in_side < 1:
            raise ValueError("an edge has one segment at least")

    @property
    def nlon(self) -> int:
        return len(self.lonb) - 1

    @property
    def nlat(self) -> int:
        """Rows, the caps included."""
        return len(self.latb) - 1 + self.south_pole + self.north_pole


def lonlat_from_hntr(spec: HntrSpec, pole_caps: bool = False, points_in_side: int = 1, eq_rad: float = 1.0) -> LonLatSpec:
    """The boundary grid of a regular grid; column 0 starts at 180 W, plus the offset."""
    if spec.im % 2:
        raise ValueError("the number of columns must be even")
    lonb = tuple(-180 + 360 / spec.im * (i + spec.offi) for i in range(spec.im + 1))
    latb = tuple(max(-90.0, min(90.0, (j - spec.jm / 2) * spec.dlat / 60)) for j in range(spec.jm + 1))
    latb = (-90.0, *latb[1:-1], 90.0)
    return LonLatSpec(lonb, latb[1:-1] if pole_caps else latb, pole_caps, pole_caps, points_in_side, eq_rad)


@dataclass(frozen=True)
class XYSpec:
    """Rectangular cells between boundaries on a projected plane."""

    xb: tuple[float, ...]
    yb: tuple[float, ...]
    sproj: str = ""

    @property
    def nx(self) -> int:
        return len(self.xb) - 1

    @property
    def ny(self) -> int:
        return len(self.yb) - 1

    @staticmethod
    def between(x0: float, x1: float, dx: float, y0: float, y1: float, dy: float, sproj: str = "") -> XYSpec:
        """Equal cells between two boundaries, their number rounded to the nearest."""
        nx, ny = (max(1, math.floor((b - a) / d + 0.5)) for a, b, d in ((x0, x1, dx), (y0, y1, dy)))
        return XYSpec(tuple(x0 + (x1 - x0) * k / nx for k in range(nx + 1)), tuple(y0 + (y1 - y0) * k / ny for k in range(ny + 1)), sproj)

    @staticmethod
    def centered(x0: float, x1: float, dx: float, y0: float, y1: float, dy: float, sproj: str = "") -> XYSpec:
        """Cells whose outermost centers are stated."""
        return XYSpec.between(x0 - dx / 2, x1 + dx / 2, dx, y0 - dy / 2, y1 + dy / 2, dy, sproj)


# Published presets of planar ice grids (kilometres) and their projections.
GREENLAND_PROJ = "+proj=stere +lon_0=-39 +lat_0=90 +lat_ts=71.0 +ellps=WGS84"
ANTARCTICA_PROJ = "+proj=stere +lon_0=0 +lat_0=-90 +lat_ts=-71.0 +ellps=WGS84"


def searise(dx_km: float = 20.0) -> XYSpec:
    """The Greenland grid of the SeaRISE project, in metres."""
    return XYSpec.between(-810e3, 710e3, dx_km * 1e3, -3410e3, -590e3, dx_km * 1e3, GREENLAND_PROJ)


# Bounds in metres and projections of two further published Greenland grids.
PISM_PROJ = "+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45 +k=1 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs"
PISM_BOUNDS = (-678650.0, 905350.0, -3371600.0, -635600.0)
MAR_PROJ = "+proj=stere +lon_0=-40.0 +lat_0=70.5 +lat_ts=0.0 +k=1.0 +a=6371229 +b=6371129 +no_defs"
MAR_CENTERS = (-775e3, 700e3, -1200e3, 1525e3)


def pism_greenland(dx: float = 18000.0) -> XYSpec:
    """The Greenland grid of a PISM spin-up, in metres."""
    x0, x1, y0, y1 = PISM_BOUNDS
    return XYSpec.between(x0, x1, dx, y0, y1, dx, PISM_PROJ)


def mar_greenland(dx_km: float = 25.0) -> XYSpec:
    """The Greenland grid of the MAR model, whose outermost centers are stated, in metres."""
    x0, x1, y0, y1 = MAR_CENTERS
    return XYSpec.centered(x0, x1, dx_km * 1e3, y0, y1, dx_km * 1e3, MAR_PROJ)


PRESETS = {
    "searise20": lambda: searise(20.0),
    "searise5": lambda: searise(5.0),
    "pism_greenland": pism_greenland,
    "mar_greenland": mar_greenland,
    "greenland_atmosphere": lambda: lonlat_from_hntr(NAMED["g2hx2"], pole_caps=True),
}


def matching_hntr(spec: LonLatSpec, hntr: HntrSpec) -> HntrSpec:
    """The regular grid that a boundary grid was made from; raises if its boundaries or caps don't agree with it."""
    for caps in (False, True):
        own = lonlat_from_hntr(hntr, caps)
        if (spec.south_pole, spec.north_pole) == (caps, caps):
            if all(len(a) == len(b) and all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True)) for a, b in ((own.lonb, spec.lonb), (own.latb, spec.latb))):
                return hntr
    raise ValueError("the grid is not the regular one that it is said to be")


def split_shape(shape: tuple[int, ...], n: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """A shape cut in two so that the last dimensions multiply to ``n``."""
    for k in range(len(shape) + 1):
        if math.prod(shape[k:]) == n:
            return shape[:k], shape[k:]
    raise ValueError(f"no last dimensions of {shape} multiply to {n}")


def parse_spec(spec: str) -> tuple[str, str]:
    """The grids of a matrix name ``BvA``, (B, A); ``BuA`` names an unscaled one."""
    for mark in "vu":
        b, sep, a = spec.partition(mark)
        if sep and b and a:
            return b, a
    raise ValueError(f"{spec!r} names no matrix")


@dataclass(frozen=True)
class Indexing:
    """n-dimensional to flat index and back; ``order`` lists dimensions from the largest stride to the smallest."""

    names: tuple[str, ...]
    base: tuple[int, ...]
    extent: tuple[int, ...]
    order: tuple[int, ...]

    @property
    def size(self) -> int:
        return math.prod(self.extent)

    @property
    def strides(self) -> tuple[int, ...]:
        out, stride = [0] * len(self.extent), 1
        for d in reversed(self.order):
            out[d] = stride
            stride *= self.extent[d]
        return tuple(out)

    def to_index(self, *t: int) -> int:
        return sum((x - b) * s for x, b, s in zip(t, self.base, self.strides, strict=True))

    def to_tuple(self, index: int) -> tuple[int, ...]:
        out = [0] * len(self.extent)
        for d in self.order:
            out[d], index = index // self.strides[d] + self.base[d], index % self.strides[d]
        return tuple(out)

    def index_column(self, *t):
        total = None
        for x, b, s in zip(t, self.base, self.strides, strict=True):
            part = (x.cast("long") - b) * s
            total = part if total is None else total + part
        return total

    def tuple_columns(self, index):
        from pyspark.sql import functions as F

        index = index.cast("long")
        return [F.pmod(F.floor((index - F.pmod(index, F.lit(s))) / s), F.lit(e)).cast("long") + b for s, e, b in zip(self.strides, self.extent, self.base, strict=True)]

    def with_extent(self, name: str, extent: int) -> Indexing:
        """The same index with another extent of one dimension."""
        k = self.names.index(name)
        return Indexing(self.names, self.base, (*self.extent[:k], extent, *self.extent[k + 1 :]), self.order)


def elevation_indexing(a: Indexing, nhc: int) -> Indexing:
    """The index of (cell, class): classes have the largest stride."""
    return Indexing(("A", "HC"), (0, 0), (a.size, nhc), (1, 0))


def div_down(a, b: int):
    """Integer division rounded towards minus infinity, of a column or a number."""
    if isinstance(a, int):
        return a // b
    from pyspark.sql import functions as F

    return ((a - F.pmod(a, F.lit(b))) / b).cast("long")


def div_up(a, b: int):
    """Integer division rounded towards plus infinity."""
    return -div_down(-a, b)


@dataclass(frozen=True)
class RegridParams:
    scale: bool = True
    correct_a: bool = False
    sigma: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def smooth(self) -> bool:
        return self.sigma[0] != 0


@dataclass
class Segment:
    """A run of elevation classes with a common meaning."""

    name: str
    start: int
    size: int
    meta: dict = field(default_factory=dict)
