"""Elevation tables: (c, r, z) samples on a global grid, rows counted from the south.

Neighbours are found inside blocks: a sample on a block border is also sent to the next
block, then window functions run in partitions that the one shuffle on the block already
satisfies. About one row in a hundred is sent twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrakit.functions.projection import to_lv95
from terrakit.functions.relief import NODATA

TILE_PX, TILE_RES_M = 500, 2.0
BLOCK = 256
c = F.col

# Which grid edges a contour joins in a cell, by the corners at or above the level
# (south-west 1, south-east 2, north-east 4, north-west 8). High ground lies on the right
# of every segment, so segments chain head to tail. Saddles have two entries: the cell
# mean at or above the level, and below.
CASES = {
    1: "WS", 2: "SE", 3: "WE", 4: "EN", 6: "SN", 7: "WN", 8: "NW",
    9: "NS", 11: "NE", 12: "EW", 13: "ES", 14: "SW",
}
SADDLES = {5: ("WN ES", "WS EN"), 10: ("NE SW", "NW SE")}


def valid_tiles(tiles: DataFrame, px: int = TILE_PX) -> tuple[DataFrame, DataFrame]:
    """(tiles of the right size, the others)."""
    right = F.coalesce(F.size("samples") == px * px, F.lit(False))
    return tiles.filter(right), tiles.filter(~right)


def mosaic(tiles: DataFrame, px: int = TILE_PX) -> DataFrame:
    """(c, r, z) from tiles (e_km, n_km, samples): tile rows run from the north, grid rows
    from the south, indices are global, so there are no seams."""
    rows = tiles.select("e_km", "n_km", F.posexplode("samples").alias("k", "z"))
    return rows.select(
        (c("e_km") * px + c("k") % px).cast("int").alias("c"),
        (c("n_km") * px + px - 1 - F.floor(c("k") / px)).cast("int").alias("r"), "z",
    )


def elevation_range(grid: DataFrame) -> DataFrame:
    valid = (c("z") != NODATA) & ~F.isnan("z")
    return grid.filter(valid).agg(F.min("z").alias("lo"), F.max("z").alias("hi"))


def _spread(grid: DataFrame, before: int, after: int, wide: int, tall: int) -> DataFrame:
    """Copies of (c, r, ...) for every block of ``wide`` columns and ``tall`` rows they are
    needed in: bc, br, and home_c, home_r where the block is their own."""
    def reach(v: str, size: int) -> Column:
        return F.array_distinct(F.array(
            F.floor((c(v) - after) / size), F.floor(c(v) / size), F.floor((c(v) + before) / size)
        ))

    spread = grid.withColumn("bc", F.explode(reach("c", wide))).withColumn("br", F.explode(reach("r", tall)))
    return spread.withColumn("home_c", c("bc") == F.floor(c("c") / wide)).withColumn("home_r", c("br") == F.floor(c("r") / tall))


def in_blocks(grid: DataFrame, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """Repartition by block with ``before``/``after`` rows and columns of overlap.

    Adds bc, br and ``home``, true in the block a sample belongs to.
    """
    spread = _spread(grid, before, after, size, size)
    return spread.withColumn("home", c("home_c") & c("home_r")).drop("home_c", "home_r").repartition("bc", "br")


def _beside(value, step: int, along: str, window) -> Column:
    """The neighbour's value where the neighbour is exactly one step away."""
    shift = F.lead if step > 0 else F.lag
    return F.when(shift(along).over(window) == c(along) + step, shift(value).over(window))


def cells2x2(grid: DataFrame, size: int = BLOCK) -> DataFrame:
    """(c, r, bc, br, sw, se, nw, ne) for every cell with its four corners present."""
    blocks = in_blocks(grid, 0, 1, size)
    rows = Window.partitionBy("bc", "br", "r").orderBy("c")
    cols = Window.partitionBy("bc", "br", "c").orderBy("r")
    out = blocks.withColumn("se", _beside("z", 1, "c", rows))
    out = out.withColumn("nw", _beside("z", 1, "r", cols)).withColumn("ne", _beside("se", 1, "r", cols))
    return out.filter("home and se is not null and nw is not null and ne is not null").select(
        "c", "r", "bc", "br", c("z").alias("sw"), "se", "nw", "ne"
    )


def tile_cells(tiles: DataFrame, interval_m: int, px: int = TILE_PX, per_block: int = 2) -> DataFrame:
    """The cells of a tile table that some contour level crosses, as cells2x2 gives them.

    Tiles (e_km, n_km, samples) are cut into rows of samples. A row gets the first sample
    of the row east of it, then the row north of it: one shuffle of whole rows by block of
    tiles, px times fewer than samples. Cells no level crosses never leave the arrays.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(px - 1)))
    rows = tiles.withColumn("k", k).select(
        c("e_km").alias("c"), (c("n_km") * px + px - 1 - c("k")).alias("r"), F.slice("samples", c("k") * px + 1, F.lit(px)).alias("zs"))
    # Copies to the block in the west only serve their first sample.
    spread = _spread(rows, 0, 1, per_block, per_block * px)
    spread = spread.withColumn("zs", F.when(c("home_c"), c("zs")).otherwise(F.slice("zs", 1, 1))).repartition("bc", "br")
    by_row = Window.partitionBy("bc", "br", "r").orderBy("c")
    by_col = Window.partitionBy("bc", "br", "c").orderBy("r")
    spread = spread.withColumn("head", c("zs")[0]).withColumn("east", _beside("head", 1, "c", by_row))
    spread = spread.withColumn("low", F.when(c("east").isNull(), c("zs")).otherwise(F.concat("zs", F.array("east"))))
    spread = spread.withColumn("high", _beside("low", 1, "r", by_col)).filter("home_c and home_r and high is not null")
    span = F.least(F.size("low"), F.size("high")) - 1
    step = float(max(interval_m, 1))

    def cell(i):
        return F.struct(i.alias("i"), c("low")[i].alias("sw"), c("low")[i + 1].alias("se"), c("high")[i].alias("nw"), c("high")[i + 1].alias("ne"))

    def crossed(x):
        corners = [x[v] for v in ("sw", "se", "nw", "ne")]
        return (F.floor(F.greatest(*corners) / step) * step > F.least(*corners)) & (F.least(*corners) > NODATA)

    cells = F.filter(F.transform(F.sequence(F.lit(0), span - 1), cell), crossed)
    return spread.filter(span > 0).select("c", "r", "bc", "br", F.inline(cells)).select(
        (c("c") * px + c("i")).cast("int").alias("c"), c("r").cast("int").alias("r"), "bc", "br", "sw", "se", "nw", "ne")


def _crossing(low: Column, high: Column, level: Column) -> Column:
    """Where the level lies between two corners, the middle for equal ones."""
    span = (high - low).cast("double")
    flat = F.abs(span) < 2.220446049250313e-16
    share = (level - low).cast("double") / F.when(flat, F.lit(1.0)).otherwise(span)
    return F.when(flat, F.lit(0.5)).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


#: Bits of an edge's number for its column and its row; what is left is the level's.
COL_BITS, ROW_BITS, LEVEL_BITS = 24, 24, 14


def _edge_key(vertical: int, col: Column, row: Column) -> Column:
    """One number per (level, grid edge): 14 bits of level, 24 of column, 24 of row, one of
    direction. Columns and rows from -2^23 on and levels from -2^13 on fit, which at 0.5 m
    samples is 4,194 km either way; anything beyond is an error, never another's number."""
    def part(value, bits, name):
        shifted = value.cast("bigint") + 2 ** (bits - 1)
        wrong = F.raise_error(F.format_string(f"grid edge does not fit: {name} %d", value.cast("bigint"))).cast("bigint")
        return F.when((shifted >= 0) & (shifted < 2**bits), shifted).otherwise(wrong)

    level, x, y = part(c("level"), LEVEL_BITS, "level"), part(col, COL_BITS, "column"), part(row, ROW_BITS, "row")
    return ((level * 2**COL_BITS + x) * 2**ROW_BITS + y) * 2 + vertical


def march(cells: DataFrame, levels: Column) -> DataFrame:
    """Contour segments of cells: (sid, level, case, c, r, bc, br, ak, bk, ae, an, be, bn).

    ``levels`` is an ARRAY column of the levels to try; only those above the lowest corner
    and at or below the highest can cross a cell. Positions are in samples, from the
    sample centres; ak and bk name the grid edges a segment starts and ends on.
    """
    low, high = F.least("sw", "se", "nw", "ne"), F.greatest("sw", "se", "nw", "ne")
    solid = ~F.array_contains(F.array("sw", "se", "nw", "ne"), F.lit(NODATA).cast(cells.schema["sw"].dataType))
    out = cells.filter(solid).withColumn("lo", low).withColumn("hi", high)
    out = out.withColumn("level", F.explode(F.filter(levels, lambda v: (v > c("lo")) & (v <= c("hi"))))).drop("lo", "hi")
    level = c("level").cast(cells.schema["sw"].dataType)
    bits = sum(
        (F.when(c(k) >= level, bit).otherwise(0) for k, bit in (("se", 2), ("ne", 4), ("nw", 8))),
        F.when(c("sw") >= level, 1).otherwise(0),
    )
    mean = (c("sw") + c("se") + c("ne") + c("nw")) / 4

    def spot(vertical, col, row, e, n):
        return F.struct(_edge_key(vertical, col, row).alias("k"), e.cast("double").alias("e"), n.cast("double").alias("n"))

    x, y = c("c"), c("r")
    edges = {
        "W": spot(1, x, y, x, y + _crossing(c("sw"), c("nw"), level)),
        "E": spot(1, x + 1, y, x + 1, y + _crossing(c("se"), c("ne"), level)),
        "S": spot(0, x, y, x + _crossing(c("sw"), c("se"), level), y),
        "N": spot(0, x, y + 1, x + _crossing(c("nw"), c("ne"), level), y + 1),
    }
    out = out.withColumn("case", bits).withColumn("high", mean >= level).withColumns(edges)

    def drawn(text):
        return F.array(*[F.struct(c(p[0]).alias("a"), c(p[1]).alias("b")) for p in text.split()])

    lines = None
    for case, text in CASES.items():
        lines = F.when(c("case") == case, drawn(text)) if lines is None else lines.when(c("case") == case, drawn(text))
    for case, (above, below) in SADDLES.items():
        lines = lines.when((c("case") == case) & c("high"), drawn(above)).when(c("case") == case, drawn(below))
    out = out.select("level", "case", "c", "r", "bc", "br", F.posexplode(lines).alias("k", "s"))
    sid = _edge_key(0, c("c"), c("r")) + c("k")
    return out.select(
        sid.alias("sid"), "level", "case", "c", "r", "bc", "br", c("s.a.k").alias("ak"), c("s.b.k").alias("bk"),
        c("s.a.e").alias("ae"), c("s.a.n").alias("an"), c("s.b.e").alias("be"), c("s.b.n").alias("bn"),
    )


def interval_levels(interval_m: int) -> Column:
    """Multiples of the interval from below the lowest corner to the highest."""
    low, high = F.least("sw", "se", "nw", "ne"), F.greatest("sw", "se", "nw", "ne")
    step = max(interval_m, 1)
    first = F.floor(low / step).cast("int")
    return F.transform(F.sequence(first, F.greatest(F.floor(high / step).cast("int"), first)), lambda k: k * step)


def levels_scanned(grid: DataFrame, interval_m: int) -> DataFrame:
    """(first, last, levels): the lowest sample is cut to a whole metre, then floored."""
    step = max(interval_m, 1)
    span = elevation_range(grid)
    first = F.floor(c("lo").cast("int") / step) * step
    last = F.floor(c("hi").cast("int") / step) * step
    return span.select(first.alias("first"), last.alias("last"), ((last - first) / step + 1).cast("bigint").alias("levels"))


def grid_bounds(grid: DataFrame) -> Column:
    """{c0, c1, r0, r1} of the grid as a scalar subquery."""
    ends = F.struct(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("r").alias("r0"), F.max("r").alias("r1"))
    return grid.agg(ends.alias("span")).scalar()


def block_means(grid: DataFrame, step: int) -> DataFrame:
    """(c, r, z): mean of the valid samples of each step x step block, null without any.
    Blocks cut off at the far edge of the grid are dropped."""
    span = grid_bounds(grid)
    col, row = F.floor((c("c") - c("span.c0")) / step), F.floor((c("r") - c("span.r0")) / step)
    full_cols = F.floor((c("span.c1") - c("span.c0") + 1) / step)
    full_rows = F.floor((c("span.r1") - c("span.r0") + 1) / step)
    placed = grid.withColumn("span", span).filter((col < full_cols) & (row < full_rows))
    valid = F.when(c("z") > NODATA, c("z").cast("double"))
    return placed.groupBy(col.cast("int").alias("c"), row.cast("int").alias("r")).agg(F.avg(valid).alias("z"))


def horn_slope(field: DataFrame, cell_m: float, size: int = BLOCK) -> DataFrame:
    """(c, r, degrees) by Horn's 3x3 gradient. Beyond the grid's edge the edge cell counts
    again; a cell with a null anywhere in its window is flat."""
    blocks = in_blocks(field, 1, 1, size).withColumn("span", grid_bounds(field))
    rows = Window.partitionBy("bc", "br", "r").orderBy("c")
    cols = Window.partitionBy("bc", "br", "c").orderBy("r")
    west, east = _beside("z", -1, "c", rows), _beside("z", 1, "c", rows)
    out = blocks.withColumn("w", west).withColumn("e", east)
    out = out.withColumn("w", F.when(c("c") == c("span.c0"), c("z")).otherwise(c("w"))).withColumn(
        "e", F.when(c("c") == c("span.c1"), c("z")).otherwise(c("e")))
    out = out.withColumn("line", F.struct("w", "z", "e"))
    out = out.withColumn("s", _beside("line", -1, "r", cols)).withColumn("n", _beside("line", 1, "r", cols))
    south = F.when(c("r") == c("span.r0"), c("line")).otherwise(c("s"))
    north = F.when(c("r") == c("span.r1"), c("line")).otherwise(c("n"))
    out = out.filter("home").select("c", "r", "line", south.alias("s"), north.alias("n"))
    east_sum = c("n.e") + 2.0 * c("line.e") + c("s.e")
    west_sum = c("n.w") + 2.0 * c("line.w") + c("s.w")
    north_sum = c("n.w") + 2.0 * c("n.z") + c("n.e")
    south_sum = c("s.w") + 2.0 * c("s.z") + c("s.e")
    dx, dy = (east_sum - west_sum) / (8.0 * cell_m), (north_sum - south_sum) / (8.0 * cell_m)
    tilt = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    known = c("line.z").isNotNull()
    return out.select("c", "r", F.when(known & tilt.isNotNull(), tilt).otherwise(F.lit(0.0)).alias("degrees"))


def slope_field(grid: DataFrame, cell_m: float = 10.0) -> DataFrame:
    """(c, r, degrees) from native samples."""
    return horn_slope(block_means(grid, max(round(cell_m / TILE_RES_M), 1)), cell_m)


def padded(field: DataFrame) -> DataFrame:
    """The field with a ring of flat cells around it, so every area closes."""
    span = field.agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("r").alias("r0"), F.max("r").alias("r1"))
    wide = F.sequence(c("c0") - 1, c("c1") + 1)
    tall = F.sequence(c("r0"), c("r1"))

    def cells(seq, make):
        return F.transform(seq, make)

    def cell(col, row):
        return F.struct(col.cast("int").alias("c"), row.cast("int").alias("r"), F.lit(0.0).alias("degrees"))

    ring = F.concat(
        cells(wide, lambda x: cell(x, c("r0") - 1)), cells(wide, lambda x: cell(x, c("r1") + 1)),
        cells(tall, lambda y: cell(c("c0") - 1, y)), cells(tall, lambda y: cell(c("c1") + 1, y)),
    )
    return field.select("c", "r", "degrees").unionByName(span.select(F.inline(ring)))


def relief_raster(grid: DataFrame, degree_cells: DataFrame, samples: int, res_m: float = TILE_RES_M) -> DataFrame:
    """(lat, lon, row, col, h SMALLINT): heights on a 1 degree cell's grid, row 0 north.

    Bilinear between the four nearest samples; any missing or nodata one gives the void
    value. A target sample looks its four neighbours up once, by one equi-join on the
    lower left sample's 2x2 cell.
    """
    step = 1.0 / (samples - 1)
    index = F.sequence(F.lit(0), F.lit(samples - 1))
    goal = degree_cells.withColumn("row", F.explode(index)).withColumn("col", F.explode(index))
    e, n = to_lv95(c("lon") + c("col") * step, (c("lat") + 1) - c("row") * step)
    goal = goal.withColumn("fx", e / res_m - 0.5).withColumn("fy", n / res_m - 0.5)
    goal = goal.withColumn("c", F.floor("fx").cast("int")).withColumn("r", F.floor("fy").cast("int"))
    joined = goal.join(cells2x2(grid).select("c", "r", "sw", "se", "nw", "ne"), ["c", "r"], "left")
    tx, ty = c("fx") - c("c"), c("fy") - c("r")
    low = c("sw").cast("double") * (1.0 - tx) + c("se").cast("double") * tx
    high = c("nw").cast("double") * (1.0 - tx) + c("ne").cast("double") * tx
    height = low * (1.0 - ty) + high * ty
    bad = F.array_contains(F.array("sw", "se", "nw", "ne"), F.lit(NODATA).cast(grid.schema["z"].dataType)) | F.isnan(height)
    whole = F.least(F.greatest(F.round(height), F.lit(-1000.0)), F.lit(9000.0))
    value = F.when(c("sw").isNull() | bad, F.lit(-32768)).otherwise(whole.cast("int")).cast("smallint")
    return joined.select("lat", "lon", "row", "col", value.alias("h"))


def coverage(raster: DataFrame) -> DataFrame:
    """(lat, lon, filled, void, coverage) per degree cell."""
    filled = F.count_if(c("h") != -32768)
    total = F.count(F.lit(1))
    return raster.groupBy("lat", "lon").agg(
        filled.alias("filled"), F.count_if(c("h") == -32768).alias("void"), (filled / total).alias("coverage")
    )
