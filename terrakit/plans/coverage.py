"""Elevation cells an area needs, and the disk they take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakit.functions.shapes import segment_distance_sq
from terrakit.operators.cells import KM, around, covering, dilated
from terrakit.operators.spatial import members
from terrakit.session import dealt

# Bytes per elevation tile and the allowance for everything else.
TILE_BYTES, OVERHEAD_BYTES = 1_200_000.0, 512 * 1024 * 1024
PROBES = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.5, 0.5)]
c = F.col


def box_cells(extents: DataFrame) -> DataFrame:
    """(area_id, e_km, n_km) of every cell a box covers."""
    return extents.select("area_id", F.inline(covering(c("min_e"), c("min_n"), c("max_e"), c("max_n"))))


def cells_needed(extents: DataFrame, rings: DataFrame | None, segments: DataFrame | None) -> DataFrame:
    """Cells of each area that its mask reaches, one cell wider, inside the box.

    A cell is reached when a corner or its centre is in the mask of the same area. Segments
    are tested against the cells in their own reach, in the row of the segment.
    """
    parts = []
    if rings is not None:
        parts.append(_cells_of_rings(extents, rings))
    if segments is not None:
        parts.append(_cells_of_segments(extents, segments))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct()


def _cells_of_segments(extents: DataFrame, segments: DataFrame) -> DataFrame:
    def first(low):
        return F.floor(low / KM).cast("int")

    def last(low, high):
        return F.greatest(F.ceil(high / KM).cast("int") - 1, first(low))

    own = extents.select(
        "area_id", first(c("min_e")).alias("first_e_km"), first(c("min_n")).alias("first_n_km"),
        last(c("min_e"), c("max_e")).alias("last_e_km"), last(c("min_n"), c("max_n")).alias("last_n_km"))

    def span(a, b, k):
        low = F.ceil((F.least(a, b) - c("radius")) / KM).cast("int") - 1
        high = F.floor((F.greatest(a, b) + c("radius")) / KM).cast("int")
        return F.greatest(low, c(f"first_{k}")), F.least(high, c(f"last_{k}"))

    (west, east), (south, north) = span(c("ax"), c("bx"), "e_km"), span(c("ay"), c("by"), "n_km")
    near = dealt(segments.join(own, c("mask_id") == c("area_id"))).filter((west <= east) & (south <= north))
    cells = near.withColumn("x", F.explode(F.sequence(west, east))).withColumn("y", F.explode(F.sequence(south, north)))
    nearest = F.least(*[
        segment_distance_sq((c("x") + dx) * KM, (c("y") + dy) * KM, c("ax"), c("ay"), c("bx"), c("by")) for dx, dy in PROBES])
    wide = cells.filter(nearest <= c("radius") * c("radius")).select(
        "area_id", "first_e_km", "first_n_km", "last_e_km", "last_n_km", F.inline(around(c("x"), c("y"), "e_km", "n_km")))
    return wide.filter(
        c("e_km").between(c("first_e_km"), c("last_e_km")) & c("n_km").between(c("first_n_km"), c("last_n_km"))
    ).select("area_id", "e_km", "n_km").distinct()


def _cells_of_rings(extents: DataFrame, rings: DataFrame) -> DataFrame:
    inside = box_cells(dealt(extents))
    cell = F.struct("area_id", "e_km", "n_km")
    probes = inside.select(
        c("area_id").alias("mask_id"), cell.alias("id"),
        F.inline(F.array(*[
            F.struct(((c("e_km") + x) * KM).alias("e"), ((c("n_km") + y) * KM).alias("n")) for x, y in PROBES
        ])),
    )
    reached = members(probes, rings, None, own_mask=True).select("id.*")
    return dilated(reached, ["area_id"]).join(inside.hint("merge"), ["area_id", "e_km", "n_km"], "left_semi")


def disk_need(tiles: Column, needs_elevation: Column) -> Column:
    """Bytes to have free before a build."""
    return F.when(needs_elevation, F.floor(tiles * TILE_BYTES).cast("bigint") + OVERHEAD_BYTES).otherwise(
        F.lit(OVERHEAD_BYTES).cast("bigint")
    )
