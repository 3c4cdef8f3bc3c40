"""Axis-aligned boxes as four columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_meets(a0e, a0n, a1e, a1n, b0e, b0n, b1e, b1n) -> Column:
    """Boxes (min_e, min_n, max_e, max_n) touch or overlap."""
    return (a0e <= b1e) & (a1e >= b0e) & (a0n <= b1n) & (a1n >= b0n)


def box_has(e: Column, n: Column, min_e, min_n, max_e, max_n) -> Column:
    return e.between(min_e, max_e) & n.between(min_n, max_n)


def box(min_e, min_n, max_e, max_n) -> Column:
    """A box struct with its corners in order."""
    def c(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        F.least(c(min_e), c(max_e)).alias("min_e"), F.least(c(min_n), c(max_n)).alias("min_n"),
        F.greatest(c(min_e), c(max_e)).alias("max_e"), F.greatest(c(min_n), c(max_n)).alias("max_n"),
    )


def centred(e: Column, n: Column, radius: Column) -> Column:
    return box(e - radius, n - radius, e + radius, n + radius)


def grown(b: Column, metres: Column) -> Column:
    return box(b["min_e"] - metres, b["min_n"] - metres, b["max_e"] + metres, b["max_n"] + metres)


def joined(a: Column, b: Column) -> Column:
    return F.struct(
        F.least(a["min_e"], b["min_e"]).alias("min_e"), F.least(a["min_n"], b["min_n"]).alias("min_n"),
        F.greatest(a["max_e"], b["max_e"]).alias("max_e"), F.greatest(a["max_n"], b["max_n"]).alias("max_n"),
    )


def area_km2(b: Column) -> Column:
    return (b["max_e"] - b["min_e"]) * (b["max_n"] - b["min_n"]) / 1e6
