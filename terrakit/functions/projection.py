"""Between the metric national grid (easting, northing) and longitude, latitude."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grid origin and coverage bounds in metres.
ORIGIN_E, ORIGIN_N = 2_600_000.0, 1_200_000.0
BOUNDS = (2_480_000.0, 1_070_000.0, 2_840_000.0, 1_300_000.0)

# Polynomial terms as (coefficient, power of y, power of x), in order.
LON_TERMS = [(2.6779094, 0, 0), (4.728982, 1, 0), (0.791484, 1, 1), (0.1306, 1, 2), (-0.0436, 3, 0)]
LAT_TERMS = [
    (16.9023892, 0, 0), (3.238272, 0, 1), (-0.270978, 2, 0), (-0.002528, 0, 2),
    (-0.0447, 2, 1), (-0.0140, 0, 3),
]
# The inverse, as (coefficient, power of lambda, power of phi).
EASTING_TERMS = [
    (2600072.37, 0, 0), (211455.93, 1, 0), (-10938.51, 1, 1), (-0.36, 1, 2), (-44.54, 3, 0),
]
NORTHING_TERMS = [
    (1200147.07, 0, 0), (308807.95, 0, 1), (3745.25, 2, 0), (76.63, 0, 2),
    (-194.56, 2, 1), (119.79, 0, 3),
]
LON_SHIFT, LAT_SHIFT = 26782.5, 169028.66


def _polynomial(terms, u, v):
    total = None
    for factor, pu, pv in terms:
        piece = F.lit(factor)
        for _ in range(pu):
            piece = piece * u
        for _ in range(pv):
            piece = piece * v
        total = piece if total is None else total + piece
    return total


def to_wgs84(e: Column, n: Column) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees."""
    y = (e - ORIGIN_E) / 1e6
    x = (n - ORIGIN_N) / 1e6
    return (
        _polynomial(LON_TERMS, y, x) * 100.0 / 36.0,
        _polynomial(LAT_TERMS, y, x) * 100.0 / 36.0,
    )


def to_lv95(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres."""
    phi = (lat * 3600.0 - LAT_SHIFT) / 10000.0
    lam = (lon * 3600.0 - LON_SHIFT) / 10000.0
    return _polynomial(EASTING_TERMS, lam, phi), _polynomial(NORTHING_TERMS, lam, phi)


def box_to_wgs84(min_e: Column, min_n: Column, max_e: Column, max_n: Column) -> list[Column]:
    """[west, south, east, north] over all four corners: the grid is rotated."""
    corners = [to_wgs84(e, n) for e in (min_e, max_e) for n in (min_n, max_n)]
    lons = [c[0] for c in corners]
    lats = [c[1] for c in corners]
    return [F.least(*lons), F.least(*lats), F.greatest(*lons), F.greatest(*lats)]


# The same two conversions as SQL text, for the SQL twins.
def _polynomial_sql(terms, u: str, v: str) -> str:
    return " + ".join(
        "*".join([f"({factor}e0)"] + [u] * pu + [v] * pv) for factor, pu, pv in terms
    )


def wgs84_sql(e: str, n: str) -> tuple[str, str]:
    y, x = f"(({e}-2600000e0)/1000000e0)", f"(({n}-1200000e0)/1000000e0)"
    return (
        f"(({_polynomial_sql(LON_TERMS, y, x)})*100e0/36e0)",
        f"(({_polynomial_sql(LAT_TERMS, y, x)})*100e0/36e0)",
    )


def lv95_sql(lon: str, lat: str) -> tuple[str, str]:
    phi = f"(({lat}*3600e0-{LAT_SHIFT}e0)/10000e0)"
    lam = f"(({lon}*3600e0-{LON_SHIFT}e0)/10000e0)"
    return (
        f"({_polynomial_sql(EASTING_TERMS, lam, phi)})",
        f"({_polynomial_sql(NORTHING_TERMS, lam, phi)})",
    )
