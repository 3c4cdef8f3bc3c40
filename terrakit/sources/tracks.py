"""Imported tracks (key, i, lon, lat, ele): measures and corridor centrelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakit.functions.boxes import box_has
from terrakit.functions.projection import BOUNDS, to_lv95
from terrakit.operators import lines
from terrakit.operators.simplify import simplify_points

TOLERANCE_M = 50.0


def projected(track: DataFrame, key: str) -> DataFrame:
    e, n = to_lv95(F.col("lon"), F.col("lat"))
    return track.select(key, "i", "ele", e.alias("e"), n.alias("n"))


def import_tracks(track: DataFrame, key: str) -> DataFrame:
    """(key, points, length_km, ascent_m, inside) per track."""
    points = projected(track, key)
    step = F.hypot(F.col("e") - F.col("ae"), F.col("n") - F.col("an"))
    measured = lines.segments(points, key).groupBy(key).agg(
        (F.coalesce(F.sum(step), F.lit(0.0)) / 1000.0).alias("length_km"),
        F.count(F.lit(1)).alias("points"),
        F.bool_and(box_has(F.col("e"), F.col("n"), *BOUNDS)).alias("inside"),
    )
    rises = lines.ascents(points, key)
    return measured.join(rises, key, "left").withColumn("ascent_m", F.coalesce("ascent_m", F.lit(0.0)))


def simplified_track(track: DataFrame, key: str) -> DataFrame:
    return simplify_points(projected(track, key), key, TOLERANCE_M)
