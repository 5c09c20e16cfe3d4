"""Units of coupling variables: a small table of factors, affine rescaling and the 365-day calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors to SI base units, with the dimension that must agree.
UNITS = {
    "1": ("1", 1.0), "m": ("m", 1.0), "km": ("m", 1e3), "cm": ("m", 1e-2), "mm": ("m", 1e-3),
    "s": ("s", 1.0), "h": ("s", 3600.0), "day": ("s", 86400.0), "year": ("s", 31536000.0),
    "kg": ("kg", 1.0), "g": ("kg", 1e-3), "J": ("J", 1.0), "kJ": ("J", 1e3), "W": ("J s-1", 1.0), "K": ("K", 1.0), "degC": ("degC", 1.0),
    "kg m-2": ("kg m-2", 1.0), "kg m-2 s-1": ("kg m-2 s-1", 1.0), "kg m-2 day-1": ("kg m-2 s-1", 1 / 86400), "kg m-2 year-1": ("kg m-2 s-1", 1 / 31536000),
    "J m-2": ("J m-2", 1.0), "W m-2": ("J m-2 s-1", 1.0), "J m-2 s-1": ("J m-2 s-1", 1.0), "m s-1": ("m s-1", 1.0), "m year-1": ("m s-1", 1 / 31536000), "m2": ("m2", 1.0), "km2": ("m2", 1e6), "J kg-1": ("J kg-1", 1.0), "kg m-3": ("kg m-3", 1.0), "W m-1 K-1": ("J s-1 m-1 K-1", 1.0), "J kg-1 K-1": ("J kg-1 K-1", 1.0), "Pa": ("Pa", 1.0), "hPa": ("Pa", 100.0), "percent": ("1", 0.01),
}


def factor(of: str, to: str) -> float:
    """What a value in units ``of`` is multiplied by to be in units ``to``."""
    if not of or not to or of == to:
        return 1.0
    try:
        (d0, f0), (d1, f1) = UNITS[of], UNITS[to]
    except KeyError as e:
        raise ValueError(f"unknown unit {e.args[0]!r}") from None
    if d0 != d1:
        raise ValueError(f"{of!r} can't be turned into {to!r}")
    return f0 / f1


def affine(value: Column, mm: float, bb: float) -> Column:
    return value * mm + bb


SECONDS_A_DAY, DAYS_A_YEAR = 86400, 365
# Days before each month of a year without leap day.
_BEFORE = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def date_365(seconds: float, base_year: int = 1950) -> str:
    """yyyymmdd of seconds since the base year began, in years of 365 days."""
    days = int(seconds // SECONDS_A_DAY)
    year, day = base_year + days // DAYS_A_YEAR, days % DAYS_A_YEAR
    month = max(k for k in range(12) if _BEFORE[k] <= day)
    return f"{year:04d}{month + 1:02d}{day - _BEFORE[month] + 1:02d}"


def date_365_column(seconds: Column, base_year: int = 1950) -> Column:
    """The same as a column."""
    days = F.floor(seconds / SECONDS_A_DAY)
    day = F.pmod(days, F.lit(DAYS_A_YEAR))
    year = (F.floor(days / DAYS_A_YEAR) + base_year).cast("int")
    before = F.array(*(F.lit(b) for b in _BEFORE))
    month = F.size(F.filter(before, lambda b: b <= day))
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad((day - F.element_at(before, month) + 1).cast("int").cast("string"), 2, "0"))
