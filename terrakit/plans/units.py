"""Administrative units: canton labels, merging, listing, extents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_canton(units: DataFrame, cantons: DataFrame) -> DataFrame:
    """Add ``canton`` by canton_number, empty where unknown. Cantons are a few dozen rows;
    the join strategy is left to their measured size."""
    names = cantons.select(F.col("number").alias("__number"), F.col("name").alias("canton"))
    return (
        units.join(names, F.col("canton_number") == F.col("__number"), "left")
        .withColumn("canton", F.coalesce("canton", F.lit("")))
        .drop("__number")
    )


def selectable(units: DataFrame, level: str) -> DataFrame:
    """Home-country units; communes share their layer with lakes and shared territory."""
    out = units.filter("icc = 'CH'")
    return out.filter("objektart = 'Gemeindegebiet'") if level == "commune" else out


def selectable_units(units: DataFrame) -> DataFrame:
    """:func:`selectable` over a table that holds every level, in its ``level`` column."""
    return units.filter("icc = 'CH' and (level <> 'commune' or objektart = 'Gemeindegebiet')")


def merged(rows: DataFrame) -> DataFrame:
    """One row per (number, name): area summed, population and canton of the first row."""
    return rows.groupBy("number", "name").agg(
        F.sum("area_km2").alias("area_km2"), F.min_by("population", "row_id").alias("population"),
        F.min_by("canton", "row_id").alias("canton"),
    )


def listed(units: DataFrame) -> DataFrame:
    return units.orderBy("name", "number")


def extent(shapes: DataFrame, buffer_m: float, keys: list[str]) -> DataFrame:
    """Box of all shapes (with min_e..max_n) per key, grown by the buffer."""
    return shapes.groupBy(*keys).agg(
        (F.min("min_e") - buffer_m).alias("min_e"), (F.min("min_n") - buffer_m).alias("min_n"),
        (F.max("max_e") + buffer_m).alias("max_e"), (F.max("max_n") + buffer_m).alias("max_n"),
    )
