"""Grid cells: the equi-join key of every spatial join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KM = 1000.0


def cell_of(v: Column, size: float) -> Column:
    return F.floor(v / size)


def cells_over(min_e, min_n, max_e, max_n, size: float) -> Column:
    """ARRAY<{cx, cy}> of every cell a closed box touches."""
    xs = F.sequence(cell_of(min_e, size), cell_of(max_e, size))
    ys = F.sequence(cell_of(min_n, size), cell_of(max_n, size))
    return _grid(xs, ys, "cx", "cy")


def _grid(xs: Column, ys: Column, x: str, y: str) -> Column:
    return F.flatten(
        F.transform(ys, lambda b: F.transform(xs, lambda a: F.struct(a.alias(x), b.alias(y))))
    )


def covering(min_e, min_n, max_e, max_n) -> Column:
    """ARRAY<{e_km, n_km}> of the kilometre cells a box needs, at least one each way; a
    box that ends on a cell border does not need the next cell."""
    def span(lo, hi):
        first = F.floor(lo / KM).cast("int")
        return F.sequence(first, F.greatest(F.ceil(hi / KM).cast("int") - 1, first))

    return _grid(span(min_e, max_e), span(min_n, max_n), "e_km", "n_km")


def degree_cells(west, south, east, north) -> Column:
    """ARRAY<{lon, lat}> of the 1 degree cells of a box."""
    def span(lo, hi):
        return F.sequence(F.floor(lo).cast("int"), F.floor(hi).cast("int"))

    return _grid(span(west, east), span(south, north), "lon", "lat")


def around(x: Column, y: Column, x_name: str, y_name: str, reach: int = 1) -> Column:
    """The 3x3 neighbourhood of a cell, itself included."""
    steps = [(a, b) for b in range(-reach, reach + 1) for a in range(-reach, reach + 1)]
    return F.array(*[F.struct((x + a).alias(x_name), (y + b).alias(y_name)) for a, b in steps])


def dilated(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct 3x3 neighbours of (keys..., e_km, n_km)."""
    return cells.select(*keys, F.inline(around(F.col("e_km"), F.col("n_km"), "e_km", "n_km"))).distinct()


def cell_counts(boxes: DataFrame) -> DataFrame:
    """Features per kilometre cell and layer: (e_km, n_km, layer, n) from rows with a box."""
    c = F.col
    return (
        boxes.select("layer", F.inline(covering(c("min_e"), c("min_n"), c("max_e"), c("max_n"))))
        .groupBy("e_km", "n_km", "layer")
        .agg(F.count(F.lit(1)).alias("n"))
    )
