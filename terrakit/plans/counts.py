"""Feature counts for areas, from boxes alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakit.functions.boxes import box_meets
from terrakit.operators.cells import cell_of, cells_over
from terrakit.session import dealt

CELL = 2_000.0
TOP = 9
BOX = ["min_e", "min_n", "max_e", "max_n"]
c = F.col


def _span(low: Column, high: Column, size: Column | float, lo: str, hi: str) -> list[Column]:
    return [cell_of(low, size).alias(lo), cell_of(high, size).alias(hi)]


def _ranges(rows: DataFrame, size: float) -> DataFrame:
    """Rows that have a box, with the cells (x0..x1, y0..y1) that it touches."""
    return rows.dropna(subset=BOX).select("*", *_span(c("min_e"), c("max_e"), size, "x0", "x1"), *_span(c("min_n"), c("max_n"), size, "y0", "y1"))


def _blocks_with(v: Column, levels: int, lv: str, key: str) -> Column:
    """The block of each level that holds cell ``v``: one for each power of four."""
    return F.array(*[F.struct(F.lit(k).alias(lv), F.shiftright(v, 2 * k).alias(key)) for k in range(levels)])


def _blocks_up_to(v: Column, levels: int, lv: str, key: str) -> Column:
    """Blocks that together hold exactly the cells 0..v: up to three on each level."""
    def piece(k, j):
        whole = F.shiftright(v + 1, 2 * k)
        return F.when(whole.bitwiseAND(F.lit(3)) >= j, F.struct(F.lit(k).alias(lv), (whole - j).alias(key)))

    return F.filter(F.array(*[piece(k, j) for k in range(levels) for j in (1, 2, 3)]), lambda p: p.isNotNull())


def _core_counts(features: DataFrame, areas: DataFrame, frame: tuple[int, int, int, int]) -> DataFrame:
    """(area_id, layer, n): features that touch a cell wholly inside the area.

    A range of cells meets another when its low corner is not beyond the other's high
    corner, less those that end before it in x, in y, plus those that end before it in
    both: four sums over all cells up to one cell, each read from a few blocks whose
    sides are powers of four. Corners beyond the frame of all areas are drawn to its rim,
    which changes no comparison, so the blocks do not grow with stray features.
    """
    west, south, east, north = frame
    wide, high = [((last - first + 3).bit_length() + 1) // 2 for first, last in ((west, east), (south, north))]

    def inner(v: str, low: int, top: int) -> Column:
        return F.greatest(F.lit(0), F.least(c(v) - (low - 1), F.lit(top - low + 2)))

    def at(kind: int, x: str, y: str) -> Column:
        ones = [F.lit(int(k == kind)).alias(f"n{k}") for k in range(4)]
        return F.struct(inner(x, west, east).alias("x"), inner(y, south, north).alias("y"), *ones)

    def upto(kind: int, x: Column, y: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (x - (west - 1)).alias("x"), (y - (south - 1)).alias("y"))

    corners = F.array(at(0, "x0", "y0"), at(1, "x1", "y0"), at(2, "x0", "y1"), at(3, "x1", "y1"))
    tallies = [f"n{k}" for k in range(4)]
    added = [F.sum(t).alias(t) for t in tallies]
    keys = ["lx", "kx", "ly", "ky"]
    sums = (
        features.select("layer", F.inline(corners)).groupBy("layer", "x", "y").agg(*added)
        .select("layer", *tallies, "y", F.inline(_blocks_with(c("x"), wide, "lx", "kx")))
        .select("layer", *tallies, "lx", "kx", F.inline(_blocks_with(c("y"), high, "ly", "ky")))
        .groupBy("layer", *keys).agg(*added)
    )
    # wholly inside: all cells of the area's range but its first and last row and column
    left, low, right, top = c("x0") + 1, c("y0") + 1, c("x1") - 1, c("y1") - 1
    ends = F.array(upto(0, right, top), upto(1, left - 1, top), upto(2, right, low - 1), upto(3, left - 1, low - 1))
    asked = (
        areas.filter((left <= right) & (low <= top)).select("area_id", F.inline(ends))
        .select("area_id", "kind", "y", F.inline(_blocks_up_to(c("x"), wide, "lx", "kx")))
        .select("area_id", "kind", *keys[:2], F.inline(_blocks_up_to(c("y"), high, "ly", "ky")))
    )
    signed = F.element_at(F.array(c("n0"), -c("n1"), -c("n2"), c("n3")), c("kind") + 1)
    return asked.join(sums.hint("merge"), keys).groupBy("area_id", "layer").agg(F.sum(signed).alias("n"))


def _rim_counts(features: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """(area_id, layer, n): features that meet the area but touch no cell wholly inside.

    A feature has cells as wide as itself, at most four; an area has the rim of its range
    on every level. A pair is counted in the cell with the low corner of its overlap,
    which always lies on the rim.
    """
    scale = [size * 2.0**k for k in range(TOP + 1)]
    extent = F.greatest(c("max_e") - c("min_e"), c("max_n") - c("min_n"))
    level = sum((F.when(extent > s, 1).otherwise(0) for s in scale[:-1]), F.lit(0))
    step = F.lit(size) * F.pow(F.lit(2.0), c("lv"))
    own = ["x0", "y0", "x1", "y1"]
    left = features.select("layer", *BOX, *own, level.alias("lv")).select("*", F.inline(cells_over(*[c(b) for b in BOX], step)))

    def side(a: Column, b: Column, across: bool) -> Column:
        def put(v):
            pair = (v, a) if across else (a, v)
            return F.struct(pair[0].alias("cx"), pair[1].alias("cy"))

        return F.transform(b, put)

    xs, ys = F.sequence("u0", "u1"), F.sequence("v0", "v1")
    rim = F.array_distinct(F.concat(side(c("v0"), xs, True), side(c("v1"), xs, True), side(c("u0"), ys, False), side(c("u1"), ys, False)))
    levels = F.explode(F.array(*[F.lit(k) for k in range(TOP + 1)])).alias("lv")
    right = (
        areas.select("area_id", *BOX, *own, levels)
        .select("*", *_span(c("min_e"), c("max_e"), step, "u0", "u1"), *_span(c("min_n"), c("max_n"), step, "v0", "v1"))
        .select("area_id", "lv", *[c(b).alias(f"a_{b}") for b in BOX + own], F.inline(rim))
    )
    corner = (cell_of(F.greatest("min_e", "a_min_e"), step) == c("cx")) & (cell_of(F.greatest("min_n", "a_min_n"), step) == c("cy"))
    core = (
        (c("x0") < c("a_x1")) & (c("x1") > c("a_x0")) & (c("a_x1") - c("a_x0") > 1)
        & (c("y0") < c("a_y1")) & (c("y1") > c("a_y0")) & (c("a_y1") - c("a_y0") > 1)
    )
    meets = box_meets(*[c(b) for b in BOX], *[c(f"a_{b}") for b in BOX])
    return left.join(right.hint("merge"), ["lv", "cx", "cy"]).filter(meets & corner & ~core).groupBy("area_id", "layer").agg(F.count(F.lit(1)).alias("n"))


def counts_in_areas(features: DataFrame, areas: DataFrame, size: float = CELL) -> DataFrame:
    """(area_id, layer, n): features whose box meets the area's box, all areas at once.

    Features that touch the inside of an area come from sums over cells; only those near
    its rim are compared one by one. Rows without a whole box count nowhere; a pair with
    no feature has no row. An empty table of areas gives no row.
    """
    # Neither table shows its size to the engine before its cells are made.
    ranged, asked = dealt(_ranges(features, size)), dealt(_ranges(areas, size))
    frame = asked.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    if frame[0] is None:
        return _rim_counts(ranged, asked, size)
    both = _core_counts(ranged, asked, tuple(frame)).unionByName(_rim_counts(ranged, asked, size))
    return both.groupBy("area_id", "layer").agg(F.sum("n").alias("n")).filter(c("n") > 0)


def group_counts(counts: DataFrame, areas: DataFrame, specs: DataFrame, presets: dict) -> DataFrame:
    """(area_id, grp, n) with zeros, honouring each area's preset and excluded layers."""
    table = [(p, need) for p, needs in presets.items() for need in sorted(needs)]
    allowed = areas.sparkSession.createDataFrame(table, "preset string, needs string")
    reads = areas.select("area_id", "preset", "excluded").join(allowed, "preset").join(
        specs.select("layer", "needs", "grp"), "needs"
    ).filter(~F.array_contains("excluded", c("layer"))).select("area_id", "layer", "grp")
    return reads.join(counts.hint("merge"), ["area_id", "layer"], "left").groupBy("area_id", "grp").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def as_predictors(grouped: DataFrame, groups: list[str]) -> DataFrame:
    """One row per area with a column per group, ready for the size model."""
    sums = [F.coalesce(F.sum(F.when(c("grp") == g, c("n"))), F.lit(0)).alias(g) for g in groups]
    return grouped.groupBy("area_id").agg(*sums)
