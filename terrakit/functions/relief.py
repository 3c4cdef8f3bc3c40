"""Contour tiers and slope bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = -9999.0
# Slope class boundaries in degrees.
SLOPE_BANDS = [30, 35, 40, 45, 50]


def tier(ele: Column, major_m: Column, medium_m: Column) -> Column:
    return (
        F.when((major_m > 0) & (ele % F.greatest(major_m, F.lit(1)) == 0), "elevation_major")
        .when((medium_m > 0) & (ele % F.greatest(medium_m, F.lit(1)) == 0), "elevation_medium")
        .otherwise("elevation_minor")
    )


def medium_reachable(interval_m: Column, major_m: Column, medium_m: Column) -> Column:
    """Some multiple of the interval is on the medium tier and not on the major one."""
    medium, major = F.greatest(medium_m, F.lit(1)), F.greatest(major_m, F.lit(1))
    hit = F.exists(
        F.sequence(F.lit(1), F.lit(1000)),
        lambda k: (k * interval_m % medium == 0) & ((major_m <= 0) | (k * interval_m % major != 0)),
    )
    return (medium_m <= 0) | hit


def slope_band(degrees: Column, bands: list[int] = SLOPE_BANDS) -> Column:
    """The highest band reached, 0 below the first."""
    out = F.lit(0)
    for band in sorted(bands):
        out = F.when(degrees >= band, F.lit(band)).otherwise(out)
    return out
