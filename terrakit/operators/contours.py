"""Flags and tags of traced contour lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakit.functions.relief import SLOPE_BANDS, tier
from terrakit.operators.chain import chain_directed
from terrakit.operators.lines import segments as line_segments
from terrakit.operators.simplify import simplify_points
from terrakit.operators.spatial import members
from terrakit.operators.terrain import cells2x2, interval_levels, march, padded, tile_cells
from terrakit.session import cut_lineage


def flag_on_ice(lines: DataFrame, key: str, ice_rings: DataFrame, size: float = 1000.0) -> DataFrame:
    """Add ``on_ice``: the middle vertex of ``pts`` lies in any ice polygon."""
    middle = F.element_at("pts", (F.floor(F.size("pts") / 2) + 1).cast("int"))
    spots = lines.select(F.col(key).alias("id"), middle.alias("m")).select("id", "m.e", "m.n")
    iced = members(spots, ice_rings, None, size).select("id").distinct()
    hits = iced.select(F.col("id").alias("__ice"))
    return (
        lines.join(hits, F.col(key) == F.col("__ice"), "left")
        .withColumn("on_ice", F.col("__ice").isNotNull())
        .drop("__ice")
    )


def _to_metres(points: DataFrame, origin_e: float, origin_n: float, cell_m: float) -> DataFrame:
    return points.withColumn("e", (F.col("e") + 0.5) * cell_m + origin_e).withColumn(
        "n", (F.col("n") + 0.5) * cell_m + origin_n
    )


def contour_lines(
    grid: DataFrame, interval_m: int = 20, major_m: int = 100, medium_m: int = 0, simplify_m: float = 8.0,
    origin_e: float = 0.0, origin_n: float = 0.0, cell_m: float = 2.0,
) -> DataFrame:
    """(line, level, tier, closed, i, e, n): traced, simplified and graded contours of a
    sample table (c, r, z) or, faster, of a tile table (e_km, n_km, samples)."""
    cells = tile_cells(grid, interval_m) if "samples" in grid.columns else cells2x2(grid)
    segments = march(cells, interval_levels(interval_m))
    traced = cut_lineage(_to_metres(chain_directed(segments), origin_e, origin_n, cell_m))
    kept = simplify_points(traced, "line", simplify_m)
    heads = traced.groupBy("line").agg(F.first("level").alias("level"), F.first("closed").alias("closed"))
    grade = tier(F.col("level"), F.lit(major_m), F.lit(medium_m))
    return kept.join(heads, "line").select("line", "level", grade.alias("tier"), "closed", "i", "e", "n")


def contour_stats(traced: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: lines, points before and after, and the share removed."""
    before = traced.agg(F.count(F.lit(1))).scalar()
    after = kept.agg(F.count(F.lit(1)).alias("points_after"), F.count_distinct("line").alias("lines"))
    share = F.when(F.col("points_before") > 0, 1.0 - F.col("points_after") / F.greatest("points_before", F.lit(1))).otherwise(0.0)
    return after.withColumn("points_before", before).withColumn("ratio", share)


def slope_areas(
    field: DataFrame, cell_m: float = 10.0, bands: list[int] | None = None, simplify_m: float = 8.0,
    min_cells: int = 12, origin_e: float = 0.0, origin_n: float = 0.0,
) -> DataFrame:
    """(line, min_deg, i, e, n): closed rings around everything at least so steep.

    Rings around fewer than ``min_cells`` cells are dropped, and those left with fewer
    than four points after simplification.
    """
    levels = F.array(*[F.lit(b) for b in (bands or SLOPE_BANDS)])
    z = padded(field).withColumnRenamed("degrees", "z")
    traced = chain_directed(march(cells2x2(z), levels)).filter("closed")
    traced = cut_lineage(_to_metres(traced, origin_e, origin_n, cell_m))
    edges = line_segments(traced.withColumn("i", F.col("i") + 1), "line").filter("ae is not null")
    cross = F.col("ae") * F.col("n") - F.col("e") * F.col("an")
    area = F.abs(F.sum(cross)) / 2.0 / (cell_m * cell_m)
    sizes = edges.groupBy("line").agg(area.alias("cells"), F.count(F.lit(1)).alias("edges"))
    large = traced.join(sizes.filter((F.col("cells") >= min_cells) & (F.col("edges") >= 3)), "line", "left_semi")
    kept = simplify_points(large, "line", simplify_m)
    usable = kept.groupBy("line").agg(F.count(F.lit(1)).alias("m")).filter("m >= 4")
    heads = large.groupBy("line").agg(F.first("level").alias("min_deg"))
    return kept.join(usable, "line", "left_semi").join(heads, "line").select("line", "min_deg", "i", "e", "n")
