"""Area selections as a table: extent, the mask each kind needs, GeoJSON in and out.

Columns: area_id, part, kind, e, n, radius_km, buffer_km, points, min_e, min_n, max_e,
max_n. A composite is several parts under one ``area_id``; nested composites flatten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakit.functions import boxes, shapes
from terrakit.functions.attrs import fixed
from terrakit.functions.projection import to_wgs84
from terrakit.plans.units import selectable_units
from terrakit.session import dealt

MASKED = ["corridor", "polygon", "circle", "adminUnits"]


def part_box() -> Column:
    """Extent of one part. A place covers its square; a corridor includes its buffer."""
    c = F.col
    radius = c("radius_km") * 1000.0
    extent = shapes.bounds(c("points"))
    nothing = boxes.box(0.0, 0.0, 0.0, 0.0)
    return (
        F.when(c("kind").isin("place", "circle"), boxes.centred(c("e"), c("n"), radius))
        .when(c("kind") == "corridor", F.coalesce(boxes.grown(extent, c("buffer_km") * 1000.0), nothing))
        .when(c("kind") == "polygon", F.coalesce(extent, nothing))
        .otherwise(boxes.box(c("min_e"), c("min_n"), c("max_e"), c("max_n")))
    )


def extents(areas: DataFrame) -> DataFrame:
    """One row per area: its box, and whether a mask applies.

    One part without a mask leaves the whole area unmasked: that part covers its box.
    """
    return areas.withColumn("box", part_box()).groupBy("area_id").agg(
        F.min("box.min_e").alias("min_e"), F.min("box.min_n").alias("min_n"),
        F.max("box.max_e").alias("max_e"), F.max("box.max_n").alias("max_n"),
        F.bool_and(F.col("kind").isin(MASKED)).alias("masked"),
    )


def mask_segments(areas: DataFrame) -> DataFrame:
    """(mask_id, radius, ax, ay, bx, by) of corridors, circles and drawn buffers.

    A single point becomes a segment without length, so it masks a disc.
    """
    c = F.col
    points = F.when(c("kind") == "circle", F.array(shapes.point(c("e"), c("n")))).otherwise(c("points"))
    radius = F.when(c("kind") == "circle", c("radius_km")).otherwise(c("buffer_km")) * 1000.0
    pairs = F.when(F.size("pts") == 1, F.array(F.struct(c("pts")[0].alias("a"), c("pts")[0].alias("b")))).otherwise(
        F.slice(shapes.edges(c("pts")), 1, F.greatest(F.size("pts") - 1, F.lit(0))))
    return (
        areas.filter(c("kind").isin("corridor", "circle"))
        .select(c("area_id").alias("mask_id"), radius.alias("radius"), points.alias("pts"))
        .select("mask_id", "radius", F.explode(pairs).alias("s"))
        .select("mask_id", "radius", c("s.a.e").alias("ax"), c("s.a.n").alias("ay"),
                c("s.b.e").alias("bx"), c("s.b.n").alias("by"))
    )


def mask_rings(areas: DataFrame) -> DataFrame:
    """(mask_id, poly, ring, pts) of drawn polygons, closed."""
    return areas.filter("kind = 'polygon'").select(
        F.col("area_id").alias("mask_id"), F.col("part").cast("bigint").alias("poly"), F.lit(0).alias("ring"),
        shapes.closed(F.col("points")).alias("pts"))


def unit_masks(areas: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rings, segments and unknown parts of areas that name administrative units.

    Parts of kind ``adminUnits`` carry ``level`` and ``numbers``; ``units`` has a row for each
    ring: level, number, icc, objektart, poly, ring, pts, with ``poly`` from 0 and its own for
    every polygon of any level. The rings' ``poly`` is -1 - poly, so they never meet the part
    numbers of :func:`mask_rings`. A unit named by several parts of an area comes once, with the
    widest buffer. The third table has (area_id, part, reason) of each part that names no known
    unit: such a part masks nothing, and a caller must not take it for an empty selection.
    """
    c = F.col
    parts = areas.filter("kind = 'adminUnits'")
    named = parts.select(
        "area_id", "part", "level", F.explode(F.array_distinct("numbers")).alias("number"),
        F.coalesce(c("buffer_km"), F.lit(0.0)).alias("buffer_km"))
    known = selectable_units(units).select("level", c("number").cast("bigint").alias("number"), "poly", "ring", "pts")
    met = named.join(known.select("level", "number"), ["level", "number"], "left_semi")
    unknown = parts.join(met.select("area_id", "part").distinct(), ["area_id", "part"], "left_anti").select(
        "area_id", "part", F.concat(
            F.lit("no_such_unit level="), F.coalesce("level", F.lit("")), F.lit(" numbers="),
            F.coalesce(F.array_join("numbers", ","), F.lit(""))).alias("reason"))
    wide = named.groupBy(c("area_id").alias("mask_id"), "level", "number").agg(F.max("buffer_km").alias("buffer_km"))
    shaped = wide.join(known, ["level", "number"]).select(
        "mask_id", (-1 - c("poly").cast("bigint")).alias("poly"), "ring", shapes.closed(c("pts")).alias("pts"), "buffer_km")
    segments = (
        shaped.filter("buffer_km > 0")
        .select("mask_id", (c("buffer_km") * 1000.0).alias("radius"), F.explode(shapes.edges(c("pts"))).alias("s"))
        .select("mask_id", "radius", c("s.a.e").alias("ax"), c("s.a.n").alias("ay"),
                c("s.b.e").alias("bx"), c("s.b.n").alias("by"))
    )
    return shaped.drop("buffer_km"), segments, unknown


def _ring_text(ring: Column) -> Column:
    def position(p):
        lon, lat = to_wgs84(p["e"], p["n"])
        return F.concat(F.lit("["), fixed(lon, 7), F.lit(","), fixed(lat, 7), F.lit("]"))

    return F.concat(F.lit("["), F.array_join(F.transform(ring, position), ","), F.lit("]"))


def outline(box: Column | None = None) -> Column:
    """The ring an area part is exported as: its own shape, a 64-gon, or its extent."""
    c = F.col
    box = part_box() if box is None else box
    frame = F.array(
        shapes.point(box["min_e"], box["min_n"]), shapes.point(box["max_e"], box["min_n"]),
        shapes.point(box["max_e"], box["max_n"]), shapes.point(box["min_e"], box["max_n"]),
        shapes.point(box["min_e"], box["min_n"]),
    )
    return (
        F.when(c("kind") == "polygon", shapes.closed(c("points")))
        .when(c("kind") == "circle", shapes.circle(c("e"), c("n"), c("radius_km") * 1000.0))
        .otherwise(frame)
    )


def to_geojson(areas: DataFrame) -> DataFrame:
    """(area_id, part, geojson): one polygon feature per part, in degrees."""
    text = F.concat(
        F.lit('{"type":"Feature","properties":{"kind":"'), F.col("kind"),
        F.lit('"},"geometry":{"type":"Polygon","coordinates":['), _ring_text(F.col("ring")), F.lit("]}}"),
    )
    return dealt(areas).withColumn("ring", outline()).select("area_id", "part", text.alias("geojson"))
