"""Geometry of polygon rings as columns: ``array<struct<vid bigint, x double, y double>>``, open, counter-clockwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<vid:bigint,x:double,y:double>>"


def _turned(ring: Column) -> Column:
    """The ring begun at its second vertex, to zip each vertex with the next one."""
    n = F.size(ring)
    return F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))


def _total(ring: Column, term) -> Column:
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(ring, _turned(ring), term), zero, lambda a, x: a + x)


def shoelace(ring: Column) -> Column:
    """Signed area; 0 for fewer than three vertices."""
    return F.when(F.size(ring) < 3, 0.0).otherwise(_total(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2)


def centroid(ring: Column) -> tuple[Column, Column]:
    """(x, y) of the area's centre; null without an area."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    area6 = shoelace(ring) * 6
    cx = _total(ring, lambda p, q: (p["x"] + q["x"]) * cross(p, q))
    cy = _total(ring, lambda p, q: (p["y"] + q["y"]) * cross(p, q))
    return F.try_divide(cx, area6), F.try_divide(cy, area6)


def box(ring: Column) -> Column:
    """Struct of x0, y0, x1, y1."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def plane_integral(ring: Column, a: Column, b: Column, c: Column) -> Column:
    """The integral of a x + b y + c over a polygon, by Green's theorem."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    ix = _total(ring, lambda p, q: (p["x"] + q["x"]) * cross(p, q)) / 6
    iy = _total(ring, lambda p, q: (p["y"] + q["y"]) * cross(p, q)) / 6
    return a * ix + b * iy + c * shoelace(ring)


def plane_through(x: list[Column], y: list[Column], z: list[Column]) -> tuple[Column, Column, Column]:
    """(a, b, c) of the plane z = a x + b y + c through three points; null if they lie on a line."""
    det = (x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])
    a = F.try_divide((z[1] - z[0]) * (y[2] - y[0]) - (z[2] - z[0]) * (y[1] - y[0]), det)
    b = F.try_divide((x[1] - x[0]) * (z[2] - z[0]) - (x[2] - x[0]) * (z[1] - z[0]), det)
    return a, b, z[0] - a * x[0] - b * y[0]


# -- the sphere -----------------------------------------------------------------------------------------------------
def graticule_area(lon0: Column, lat0: Column, lon1: Column, lat1: Column, radius: float = 1.0) -> Column:
    """Exact area between two meridians and two parallels, in degrees."""
    return F.radians(lon1 - lon0) * (F.sin(F.radians(lat1)) - F.sin(F.radians(lat0))) * (radius * radius)


def polar_cap_area(colatitude: Column, radius: float = 1.0) -> Column:
    """Area within ``colatitude`` degrees of a pole."""
    return (1 - F.cos(F.radians(colatitude))) * (2 * math.pi * radius * radius)


def lon_normal(lon: Column, start: float = -180.0) -> Column:
    """The longitude in [start, start + 360)."""
    return F.pmod(lon - start, F.lit(360.0)) + start


def lon_intersects(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two eastward ranges of longitude share more than an edge, around the globe."""
    shift = F.pmod(b0 - a0, F.lit(360.0))
    return (shift < a1 - a0) | (shift + (b1 - b0) > 360)


def haversine(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Angle between two points, in degrees."""
    dlat, dlon = F.radians(lat1 - lat0), F.radians(lon1 - lon0)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(dlon / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


# -- clips: which cells of a lon/lat grid to make ---------------------------------------------------------------------
def clip_azimuthal(lon: float, lat: float, degrees: float):
    """Cells with a corner within an angle of a point."""

    def keep(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
        near = [haversine(a, b, F.lit(lon), F.lit(lat)) <= degrees for a in (lon0, lon1) for b in (lat0, lat1)]
        return near[0] | near[1] | near[2] | near[3]

    return keep


def clip_lonlat(west: float, south: float, east: float, north: float):
    """Cells that share area with a box, which may cross the date line."""
    width = (east - west) % 360 or 360.0

    def keep(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
        return lon_intersects(lon0, lon1, F.lit(west), F.lit(west + width)) & (lat0 < north) & (lat1 > south)

    return keep


def clip_polygon(points: list[tuple[float, float]]):
    """Cells whose box shares area, or a point, with a polygon ``(lon, lat)`` of three vertices or more, on the plane of longitude and latitude."""
    if len(points) < 3:
        raise ValueError("a polygon needs three vertices")
    turned = points[1:] + points[:1]
    edges = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("ax", "ay", "bx", "by"), (*a, *b), strict=True))) for a, b in zip(points, turned, strict=True)))

    def inside(x: Column, y: Column) -> Column:
        """Whether a ray to the east crosses an odd number of edges."""
        across = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < e["ax"] + (y - e["ay"]) * F.try_divide(e["bx"] - e["ax"], e["by"] - e["ay"]))
        return F.size(F.filter(edges, across)) % 2 == 1

    def keep(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
        def touches(e: Column) -> Column:
            """Whether an edge has a part in the box: the ends of its stay in x and in y overlap."""
            dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]

            def stay(at: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
                a, b = F.try_divide(lo - at, d), F.try_divide(hi - at, d)
                out = (at < lo) | (at > hi)
                return F.when(d == 0, F.when(out, 2.0).otherwise(0.0)).otherwise(F.least(a, b)), F.when(d == 0, F.when(out, -1.0).otherwise(1.0)).otherwise(F.greatest(a, b))

            (x0, x1), (y0, y1) = stay(e["ax"], dx, lon0, lon1), stay(e["ay"], dy, lat0, lat1)
            return F.greatest(x0, y0, F.lit(0.0)) <= F.least(x1, y1, F.lit(1.0))

        return F.exists(edges, touches) | inside(lon0, lat0)

    return keep


def keep_all(*_: Column) -> Column:
    return F.lit(True)


# The zones of the ice sheets (west, south, east, north), as bits.
GREENLAND, ANTARCTICA = 1, 2
GREENLAND_ZONE = (-74.0, 59.0, -10.0, 87.5)
ANTARCTICA_NORTH = -60.0


def clip_sheets(zones: int):
    """Cells in the zone of Greenland, of Antarctica, or of both."""

    def keep(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
        out = F.lit(False)
        if zones & GREENLAND:
            out = out | clip_lonlat(*GREENLAND_ZONE)(lon0, lat0, lon1, lat1)
        if zones & ANTARCTICA:
            out = out | (lat0 <= ANTARCTICA_NORTH)
        return out

    return keep
