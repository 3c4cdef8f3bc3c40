"""Pixel tables (spot, px, cr, cg, cb): dominant colours, seasonal shifts, picture checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrakit.functions.attrs import area_fill, ink_fill, tinted

MIN_PIXELS = 500
TOLERANCE_PERCENT = 0.2
CHANNELS = ["cr", "cg", "cb"]
c = F.col


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    def two(v):
        return F.lpad(F.hex(F.least(F.greatest(v.cast("int"), F.lit(0)), F.lit(255))), 2, "0")

    return F.concat(F.lit("#"), two(r), two(g), two(b))


def dominant_colours(pixels: DataFrame, top: int = 3) -> DataFrame:
    """(spot, rank, colour, percent) of the most common fill colours per spot."""
    counted = pixels.filter(tinted(*[c(x) for x in CHANNELS])).groupBy("spot", *CHANNELS).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("spot").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("spot").orderBy(c("n").desc(), *CHANNELS)
    ranked = counted.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= top)
    return ranked.join(totals, "spot").select(
        "spot", "rank", hex_colour(*[c(x) for x in CHANNELS]).alias("colour"),
        F.round(100.0 * c("n") / c("total"), 1).alias("percent"))


def fill_medians(pixels: DataFrame, ink: bool = False, least: int = MIN_PIXELS) -> DataFrame:
    """Channel-wise median of the fill per spot; spots with too few fill pixels have none.

    The 256 possible values of a channel bound the state of a median.
    """
    test = (ink_fill if ink else area_fill)(*[c(x) for x in CHANNELS])
    return pixels.filter(test).groupBy("spot").agg(
        *[F.bround(F.median(x)).cast("int").alias(x) for x in CHANNELS], F.count(F.lit(1)).alias("n")
    ).filter(c("n") >= least).drop("n")


def seasonal_shift(summer: DataFrame, winter: DataFrame, key: str) -> DataFrame:
    """(key, dr, dg, db): winter minus summer, by the median over spots read in both."""
    theirs = winter.select("spot", *[c(x).alias(f"w_{x}") for x in CHANNELS])
    both = summer.join(theirs, "spot")
    return both.groupBy(key).agg(*[
        F.bround(F.median(f"w_{x}") - F.median(x)).cast("int").alias(f"d{x[1]}") for x in CHANNELS])


def shifted(r: Column, g: Column, b: Column) -> Column:
    """A day colour moved by dr, dg, db."""
    return hex_colour(r + c("dr"), g + c("dg"), b + c("db"))


def derived(child: list[Column], parent_day: list[Column], parent_winter: list[Column]) -> Column:
    """A colour that keeps its day-time offset from its parent."""
    return hex_colour(*[w + (k - d) for k, d, w in zip(child, parent_day, parent_winter)])


def difference(golden: DataFrame, current: DataFrame, tolerance: float = TOLERANCE_PERCENT) -> DataFrame:
    """(spot, percent, verdict): share of pixels that changed; another size counts as all.

    Pictures have columns spot, px, cr, cg, cb and release.
    """
    theirs = current.select("spot", "px", *[c(x).alias(f"n_{x}") for x in CHANNELS], c("release").alias("n_release"))
    same = c("cr").eqNullSafe(c("n_cr")) & c("cg").eqNullSafe(c("n_cg")) & c("cb").eqNullSafe(c("n_cb"))
    both = golden.join(theirs, ["spot", "px"], "full")
    out = both.groupBy("spot").agg(
        F.avg(F.when(same, 0.0).otherwise(100.0)).alias("share"),
        F.bool_or(c("cr").isNull() | c("n_cr").isNull()).alias("resized"),
        F.max("release").alias("release"), F.max("n_release").alias("n_release"))
    percent = F.when(c("resized"), 100.0).otherwise(c("share"))
    return out.select(
        "spot", percent.alias("percent"),
        F.when(percent > tolerance, "differs").otherwise("ok").alias("verdict"),
        (c("release") != c("n_release")).alias("release_changed"))
