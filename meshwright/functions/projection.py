"""The ellipsoidal polar stereographic projection, as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoids, as semi-major axis (m) and flattening.
ELLIPSOIDS = {"WGS84": (6378137.0, 1 / 298.257223563), "sphere": (6371000.0, 0.0)}


@dataclass(frozen=True)
class PolarStereographic:
    lon_0: float
    lat_0: float
    lat_ts: float
    ellps: str = "WGS84"

    @staticmethod
    def parse(sproj: str) -> PolarStereographic:
        """From a ``+proj=stere`` string with a pole as its centre."""
        f = dict(p.lstrip("+").split("=", 1) for p in sproj.split() if "=" in p)
        if f.get("proj") != "stere" or abs(float(f.get("lat_0", 0))) != 90 or f.get("ellps", "WGS84") not in ELLIPSOIDS:
            raise ValueError(f"only polar stereographic projections are known, not {sproj!r}")
        lat_0 = float(f["lat_0"])
        return PolarStereographic(float(f.get("lon_0", 0)), lat_0, float(f.get("lat_ts", lat_0)), f.get("ellps", "WGS84"))

    def _constants(self) -> tuple[float, float, float]:
        a, flat = ELLIPSOIDS[self.ellps]
        e = math.sqrt(2 * flat - flat * flat)
        ts = math.radians(abs(self.lat_ts))
        if abs(abs(self.lat_ts) - 90) < 1e-12:
            return e, 2 * a / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e)), 1.0
        s = math.sin(ts)
        t = math.tan(math.pi / 4 - ts / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)
        return e, a * math.cos(ts) / math.sqrt(1 - (e * s) ** 2), t

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(x, y) in metres of degrees."""
        e, scale, tc = self._constants()
        sign = 1 if self.lat_0 > 0 else -1
        phi, lam = F.radians(lat * sign), F.radians(lon - self.lon_0)
        s = F.sin(phi)
        t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s * e) / (1 + s * e), F.lit(e / 2))
        rho = t * (scale / tc)
        return rho * F.sin(lam), rho * F.cos(lam) * -sign

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lon, lat) in degrees of metres; the latitude by its series in the conformal latitude."""
        e, scale, tc = self._constants()
        sign = 1 if self.lat_0 > 0 else -1
        t = F.sqrt(x * x + y * y) * (tc / scale)
        chi = math.pi / 2 - 2 * F.atan(t)
        e2 = e * e
        phi = chi + F.sin(2 * chi) * (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360) + F.sin(4 * chi) * (7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520) + F.sin(6 * chi) * (7 * e2**3 / 120 + 81 * e2**4 / 1120) + F.sin(8 * chi) * (4279 * e2**4 / 161280)
        lam = F.atan2(x, y * -sign)
        lon = F.pmod(F.degrees(lam) + self.lon_0 + 180, F.lit(360.0)) - 180
        return lon, F.degrees(phi) * sign
