"""Spatial joins as equi-joins on cells with an exact test behind.

Mask sides are turned into one table of cells of several sizes under the key (lv, kx, ky):
cells wholly inside a mask, merged upwards into columns of 8 and 64, cells with the edges
or segments that decide there, and small cells where many segments meet. A point looks up
its ancestors on every level in one join, so it is read and shuffled once however many
kinds of cells a mask has. A crowded cell is split by the engine's skew handling.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrakit.functions.shapes import crosses, edges, segment_distance_sq
from terrakit.operators.cells import around, cell_of, cells_over
from terrakit.session import dealt, written

EDGE_LIMIT = 20_000
CROWD, FINE = 1_000, 8
CELL = 1000.0
SMALL = -1
#: Nearest targets: a cell's parts are cells 2 ** STEP times narrower, or LEAF targets.
STEP, LEAF = 3, 64
#: Full cells are 1, 8 or 64 cells tall: lv is the number of binary digits left out.
TALL = (0, 3, 6)
c = F.col


def _keys_of(size: float, levels: tuple[int, ...]) -> Column:
    """ARRAY<{lv, kx, ky}> of the cells that a point (e, n) looks up."""
    def key(lv):
        if lv == SMALL:
            return F.struct(F.lit(SMALL).alias("lv"), cell_of(c("e"), size / FINE).alias("kx"), cell_of(c("n"), size / FINE).alias("ky"))
        return F.struct(F.lit(lv).alias("lv"), cell_of(c("e"), size).alias("kx"), F.shiftright(cell_of(c("n"), size), lv).alias("ky"))

    return F.array(*[key(lv) for lv in levels])


def _reach(rows: DataFrame, size: float) -> DataFrame:
    """Rows (cx, cy, segment, r2) whose cell the segment reaches, with ``full`` where it
    reaches all four corners: distance to a segment is convex, so then the whole cell."""
    def gap(dx: float, dy: float) -> Column:
        return segment_distance_sq(
            (c("cx") + dx) * size, (c("cy") + dy) * size, c("ax"), c("ay"), c("bx"), c("by")
        )

    corners = F.greatest(*[gap(x, y) for x in (0.0, 1.0) for y in (0.0, 1.0)])
    reach = (F.sqrt("r2") + size * math.sqrt(0.5)) * (1 + 1e-9)
    return rows.filter(gap(0.5, 0.5) <= reach * reach).withColumn("full", corners <= c("r2") * (1 - 1e-9))


def _cells(rows: DataFrame, keys: list[str], crowd: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, crowded, rows of crowded cells).

    A full cell is one row without a segment. A cell that is not full keeps its segments,
    unless more than ``crowd`` reach it.
    """
    where = [*keys, "cx", "cy"]
    stats = rows.groupBy(*where).agg(F.bool_or("full").alias("full"), F.count(F.lit(1)).alias("m"))
    # All branches read both columns, so the engine can share one aggregation.
    most = F.lit(crowd if crowd is not None else 2**62)
    full = stats.filter(c("full") & (c("m") > 0)).select(*where, F.lit(True).alias("full"))
    quiet = stats.filter(~c("full") & (c("m") <= most)).select(*where)
    crowded = stats.filter(~c("full") & (c("m") > most)).select(*where)
    part = rows.join(quiet.hint("merge"), where, "left_semi").select(*where, "full", "ax", "ay", "bx", "by", "r2")
    return part.unionByName(full, allowMissingColumns=True), crowded, rows.join(crowded.hint("merge"), where, "left_semi")


def near_cells(
    segments: DataFrame, keys: list[str], radius: Column, size: float, crowd: int = CROWD
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plain cells, crowded cells, fine cells) within reach of segments.

    Cells are (keys..., cx, cy, full, ax, ay, bx, by, r2). A cell that more than ``crowd``
    segments reach but none fills would cost every point in it that many tests. It is cut
    into FINE x FINE cells, most of which are full or out of reach.
    """
    base = segments.withColumn("__r", radius)
    box = cells_over(
        F.least("ax", "bx") - c("__r"), F.least("ay", "by") - c("__r"),
        F.greatest("ax", "bx") + c("__r"), F.greatest("ay", "by") + c("__r"), size,
    )
    rows = base.select(*keys, "ax", "ay", "bx", "by", (c("__r") * c("__r")).alias("r2"), F.inline(box))
    plain, crowded, inner = _cells(_reach(rows, size), keys, crowd)
    steps = F.sequence(F.lit(0), F.lit(FINE - 1))
    inner = inner.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    inner = inner.withColumn("cx", c("cx") * FINE + c("i")).withColumn("cy", c("cy") * FINE + c("j")).drop("i", "j", "full")
    fine, _, _ = _cells(_reach(inner, size / FINE), keys, None)
    return plain, crowded, fine


def _near_test() -> Column:
    gap = segment_distance_sq(c("e"), c("n"), c("ax"), c("ay"), c("bx"), c("by"))
    return c("full") | (gap <= c("r2"))


def _segment_cells(segments: DataFrame, keys: list[str], radius: Column, size: float, crowd: int) -> DataFrame:
    """Cells (keys..., lv, kx, ky, full, ax, ay, bx, by, r2); no cell of a key is on two levels."""
    plain, _, fine = near_cells(segments, keys, radius, size, crowd)
    names = {"cx": "kx", "cy": "ky"}
    return plain.withColumnsRenamed(names).withColumn("lv", F.lit(0)).unionByName(
        fine.withColumnsRenamed(names).withColumn("lv", F.lit(SMALL)))


def within_distance(
    points: DataFrame, segments: DataFrame, radius: float, size: float | None = None, crowd: int = CROWD
) -> DataFrame:
    """Points (any columns, with e, n) no further than ``radius`` from any segment.

    By default a cell is small enough to be full as soon as a segment passes through it.
    """
    size = size or max(radius / math.sqrt(2.0), 1.0)
    cells = _segment_cells(segments, [], F.lit(float(radius)), size, crowd)
    cells = cells.withColumnsRenamed({k: f"__{k}" for k in ("lv", "kx", "ky")})
    placed = points.select("*", F.explode(_keys_of(size, (SMALL, 0))).alias("__at"))
    match = (c("__at.lv") == c("__lv")) & (c("__at.kx") == c("__kx")) & (c("__at.ky") == c("__ky"))
    return placed.join(cells, match & _near_test(), "left_semi").drop("__at")


def _edge_rows(rings: DataFrame, size: float) -> DataFrame:
    """The edges of rings (mask_id, poly, ring, pts), a row for each cell that one touches.

    ``rn`` is the height of the edge's end beyond the cell's east side, where it has one
    end there; ``row_x`` the row where it meets that side.
    """
    flat = rings.select("mask_id", "poly", "ring", F.explode(edges(c("pts"))).alias("x")).select(
        "mask_id", "poly", "ring",
        c("x.b.e").alias("ae"), c("x.b.n").alias("an"), c("x.a.e").alias("be"), c("x.a.n").alias("bn"),
    )
    low, high = F.least("an", "bn"), F.greatest("an", "bn")
    west, east = F.least("ae", "be"), F.greatest("ae", "be")
    rows = flat.withColumn("cy", F.explode(F.sequence(cell_of(low, size), cell_of(high, size))))
    # The part of the edge in a row, a little longer: an edge too many changes no answer.
    slack = size * 1e-7
    rise = F.when(c("an") == c("bn"), F.lit(1.0)).otherwise(c("bn") - c("an"))

    def at(n):
        return F.when(c("an") == c("bn"), c("ae")).otherwise(c("ae") + (n - c("an")) * (c("be") - c("ae")) / rise)

    one, two = at(F.greatest(low, c("cy") * size)), at(F.least(high, (c("cy") + 1) * size))
    level = c("an") == c("bn")
    first = F.greatest(F.when(level, west).otherwise(F.least(one, two) - slack), west)
    last = F.least(F.when(level, east).otherwise(F.greatest(one, two) + slack), east)
    rows = rows.withColumn("cx", F.explode(F.sequence(
        F.least(cell_of(first, size), cell_of(last, size)), F.greatest(cell_of(first, size), cell_of(last, size)))))
    side = (c("cx") + 1) * size
    run = F.when(c("ae") == c("be"), F.lit(1.0)).otherwise(c("be") - c("ae"))
    meets = c("an") + (side - c("ae")) * (c("bn") - c("an")) / run
    row_x = F.least(F.greatest(cell_of(meets, size), cell_of(low, size)), cell_of(high, size))
    across = (c("ae") >= side) != (c("be") >= side)
    beyond = (c("ae") >= side) & (c("be") >= side)
    return rows.select(
        "mask_id", "poly", "ring", "cx", "cy", "ae", "an", "be", "bn",
        F.when(across, F.when(c("ae") >= side, c("an")).otherwise(c("bn"))).alias("rn"),
        F.when(across, row_x).alias("row_x"), beyond.alias("beyond"),
    )


def _crossings(rows: DataFrame) -> DataFrame:
    """(mask_id, poly, ring, cx, cy) once for each edge and east side of a column that it meets."""
    edge = ["mask_id", "poly", "ring", "ae", "an", "be", "bn", "cx"]
    met = rows.filter("row_x is not null")
    return met.filter(c("cy") == c("row_x")).select("mask_id", "poly", "ring", "cx", "cy").unionByName(
        # Rounding may put the meeting a row beside all rows that the edge has in the column.
        met.groupBy(*edge).agg(F.bool_or(c("cy") == c("row_x")).alias("has"), F.first("row_x").alias("cy"))
        .filter("not has").select("mask_id", "poly", "ring", "cx", "cy"))


def _stacked(low: Column, high: Column, levels: tuple[int, ...]) -> Column:
    """ARRAY<{lv, ky}> of the tallest cells that make up the rows low to high of a column."""
    lv = levels[-1]
    none = F.expr("cast(array() as array<struct<lv:int,ky:bigint>>)")
    first = -F.shiftright(-low, lv)
    after = F.shiftright(high + 1, lv)
    whole = F.when(first < after, F.transform(
        F.sequence(first, after - 1), lambda k: F.struct(F.lit(lv).alias("lv"), k.cast("bigint").alias("ky")))).otherwise(none)
    if not lv:
        return whole
    fewer = levels[:-1]
    base = F.shiftleft(first, lv)
    top = F.shiftleft(after, lv)
    return F.when(first < after, F.concat(_stacked(low, base - 1, fewer), whole, _stacked(top, high, fewer))).otherwise(
        _stacked(low, high, fewer))


def polygon_cells(rings: DataFrame, size: float = CELL, edge_limit: int = EDGE_LIMIT) -> DataFrame:
    """Cells (mask_id, poly, lv, kx, ky, full, heavy, rings) of rings (mask_id, poly, ring, pts).

    The eastward ray of a point crosses a ring an odd number of times if, of the edges
    that meet the east side of the point's cell above it and the edges in the cell that
    the ray crosses, there is an odd number; where such an edge ends beyond that side and
    above the point, once more. So a cell needs its own edges and one parity, which is a
    running count down the column. Between two touched cells of a column the count does
    not change: that run is all inside or all outside. Rows follow the edges and the cells
    that they touch, not the area. A cell with more than ``edge_limit`` edges has its
    edges in rows of their own (``heavy``), so no row grows without bound.
    """
    column = ["mask_id", "poly", "cx"]
    where = [*column, "cy"]
    rows = _edge_rows(rings, size)
    crowded = rows.groupBy(*where).agg(F.count(F.lit(1)).alias("m")).filter(c("m") > edge_limit).select(*where, F.lit(True).alias("heavy"))
    local = rows.join(crowded.hint("merge"), where, "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    edge = F.struct("ae", "an", "be", "bn", "rn")
    events = local.select(
        *where, "ring", F.lit(0).alias("met"), (c("row_x") > c("cy")).cast("int").alias("above"), "heavy",
        F.when(~c("heavy") & ~c("beyond"), edge).alias("edge"),
    ).unionByName(_crossings(rows).select(*where, "ring", F.lit(1).alias("met")), allowMissingColumns=True)
    rings_of = events.repartition(*column).groupBy(*where, "ring").agg(
        F.sum("met").alias("met"), F.coalesce(F.sum("above"), F.lit(0)).alias("above"),
        F.coalesce(F.bool_or("heavy"), F.lit(False)).alias("heavy"), F.collect_list("edge").alias("edges"))
    down = Window.partitionBy(*column, "ring").orderBy(F.desc("cy"))
    before = F.coalesce(F.sum("met").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rings_of = rings_of.withColumn("before", before).select(
        *where, "ring", "heavy", (c("before") % 2).cast("int").alias("was"), ((c("before") + c("met")) % 2).cast("int").alias("is"),
        F.struct("ring", ((c("before") + c("above")) % 2).cast("int").alias("parity"), "edges").alias("own"))
    outer = c("ring") == 0
    cells = rings_of.groupBy(*where).agg(
        F.coalesce(F.sum(F.when(outer, c("is") - c("was"))), F.lit(0)).alias("outer_step"),
        F.coalesce(F.sum(F.when(~outer, c("is") - c("was"))), F.lit(0)).alias("holes_step"),
        F.coalesce(F.sum(F.when(~outer, c("was"))), F.lit(0)).alias("own_holes"),
        F.bool_or(outer).alias("has_outer"), F.bool_or("heavy").alias("heavy"), F.collect_list("own").alias("rings"))
    down = Window.partitionBy(*column).orderBy(F.desc("cy"))
    over = down.rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({
        "outer": F.coalesce(F.sum("outer_step").over(over), F.lit(0)),
        "holes": F.coalesce(F.sum("holes_step").over(over), F.lit(0)), "next": F.lead("cy").over(down),
    })
    whole = F.struct(F.lit(0).alias("ring"), F.lit(1).alias("parity"), F.expr(
        "cast(array() as array<struct<ae:double,an:double,be:double,bn:double,rn:double>>)").alias("edges"))
    touched = (c("holes") == c("own_holes")) & (c("has_outer") | (c("outer") == 1))
    own = F.struct(
        F.lit(0).alias("lv"), c("cy").alias("ky"), F.lit(False).alias("full"), "heavy",
        F.when(c("has_outer"), c("rings")).otherwise(F.concat("rings", F.array(whole))).alias("rings"))
    # From the cell below a touched one down to the next touched one.
    inside = (c("outer") + c("outer_step") == 1) & (c("holes") + c("holes_step") == 0) & (c("next") < c("cy") - 1)
    run = F.transform(_stacked(c("next") + 1, c("cy") - 1, TALL), lambda x: F.struct(
        x["lv"].alias("lv"), x["ky"].alias("ky"), F.lit(True).alias("full"), F.lit(False).alias("heavy"), F.lit(None).alias("rings")))
    none = F.slice(F.array(own), 2, 1)
    made = F.concat(F.when(touched, F.array(own)).otherwise(none), F.when(inside, run).otherwise(none))
    made = cells.select("mask_id", "poly", c("cx").alias("kx"), F.inline(made))
    alone = local.filter("heavy and not beyond").select(
        "mask_id", "poly", c("cx").alias("kx"), F.lit(0).alias("lv"), c("cy").alias("ky"), F.lit(False).alias("full"), "heavy",
        F.array(F.struct("ring", F.lit(0).alias("parity"), F.array(edge).alias("edges"))).alias("rings"))
    return made.unionByName(alone)


def _odd(r: Column) -> Column:
    """Whether the edges of a ring in the point's cell, and its parity there, make an odd count."""
    hits = F.filter(r["edges"], lambda x: crosses(c("e"), c("n"), x["ae"], x["an"], x["be"], x["bn"]) != F.coalesce(
        x["rn"] > c("n"), F.lit(False)))
    return (r["parity"] + F.size(hits)) % 2 == 1


def _inside_test() -> Column:
    return F.exists("rings", lambda r: (r["ring"] == 0) & _odd(r)) & ~F.exists("rings", lambda r: (r["ring"] > 0) & _odd(r))


def _found(points: DataFrame, cells: DataFrame, size: float, levels: tuple[int, ...], own_mask: bool) -> DataFrame:
    """Distinct (mask_id, poly, id) of points (id, e, n) and the cells that hold them, dealt
    out by (mask_id, id)."""
    names = {k: f"__{k}" for k in ("lv", "kx", "ky")} | ({"mask_id": "__mask"} if own_mask else {})
    match = (c("lv") == c("__lv")) & (c("kx") == c("__kx")) & (c("ky") == c("__ky"))
    match = match & (c("mask_id") == c("__mask")) if own_mask else match
    own = ["mask_id"] if own_mask else []
    placed = points.select(*own, "id", "e", "n", F.inline(_keys_of(size, levels)))
    sure = F.when(c("full"), True).when(c("r2").isNotNull(), _near_test()).when(c("heavy"), False).otherwise(_inside_test())
    # Of a heavy cell a row tells one edge, or the parity of each ring there.
    part = F.when(c("heavy"), F.transform("rings", lambda r: F.struct(r["ring"].alias("ring"), _odd(r).cast("int").alias("odd"))))
    # By its input a table looks small, however many cells come of it: never sent to all tasks.
    hits = placed.join(cells.withColumnsRenamed(names).hint("merge"), match).select("mask_id", "poly", "id", sure.alias("sure"), part.alias("part"))
    hits = hits.filter("sure or exists(part, x -> x.odd = 1)").repartition("mask_id", "id")
    hits = hits.select("mask_id", "poly", "id", "sure", F.explode_outer("part").alias("x"))
    by_ring = hits.groupBy("mask_id", "id", "poly", c("x.ring").alias("ring")).agg(
        F.bool_or("sure").alias("sure"), (F.sum("x.odd") % 2 == 1).alias("odd"))
    by_poly = by_ring.groupBy("mask_id", "id", "poly").agg(
        F.bool_or("sure").alias("sure"), F.bool_or((c("ring") == 0) & c("odd")).alias("outer"),
        F.bool_or((c("ring") > 0) & c("odd")).alias("hole"))
    return by_poly.filter("sure or (coalesce(outer, false) and not coalesce(hole, false))").select("mask_id", "poly", "id")


def _mask_cells(rings: DataFrame | None, segments: DataFrame | None, size: float, crowd: int, edge_limit: int) -> tuple[DataFrame, tuple[int, ...]]:
    """The cells of polygons and corridors together, and the levels they are on."""
    kinds = "full boolean, heavy boolean, poly bigint, ax double, ay double, bx double, by double, r2 double, " \
        "rings array<struct<ring:int,parity:int,edges:array<struct<ae:double,an:double,be:double,bn:double,rn:double>>>>"
    names = [k.strip().split(" ", 1) for k in kinds.split(", ")]
    tables = []
    if rings is not None:
        tables.append(polygon_cells(dealt(rings), size, edge_limit))
    if segments is not None:
        tables.append(_segment_cells(dealt(segments), ["mask_id"], c("radius"), size, crowd))
    out = None
    for table in tables:
        table = table.select("mask_id", "lv", "kx", "ky", *[
            (c(k) if k in table.columns else F.lit(False) if k == "heavy" else F.lit(None)).cast(kind).alias(k) for k, kind in names])
        out = table if out is None else out.unionByName(table)
    return out, (TALL if segments is None else (SMALL, 0) if rings is None else (SMALL, *TALL))


def in_polygons(
    points: DataFrame, rings: DataFrame, size: float = CELL, own_mask: bool = False, edge_limit: int = EDGE_LIMIT
) -> DataFrame:
    """Pairs (mask_id, poly, id) of points (id, e, n) inside a polygon.

    With ``own_mask`` the points carry a mask_id and are tested against that mask only.
    """
    cells, levels = _mask_cells(rings, None, size, CROWD, edge_limit)
    return _found(points, cells, size, levels, own_mask)


def near_segments(
    points: DataFrame, segments: DataFrame, size: float = CELL, own_mask: bool = False, crowd: int = CROWD
) -> DataFrame:
    """Pairs (mask_id, id) of points within ``radius`` of a mask's segments."""
    cells, levels = _mask_cells(None, segments, size, crowd, EDGE_LIMIT)
    return _found(points, cells, size, levels, own_mask).select("mask_id", "id")


def members(
    points: DataFrame, rings: DataFrame | None, segments: DataFrame | None,
    size: float = CELL, own_mask: bool = False, crowd: int = CROWD, edge_limit: int = EDGE_LIMIT,
) -> DataFrame:
    """Distinct (mask_id, id) of points in the union of a mask's polygons and corridors."""
    cells, levels = _mask_cells(rings, segments, size, crowd, edge_limit)
    return _found(points, cells, size, levels, own_mask).select("mask_id", "id").distinct()


def boundary_segments(rings: DataFrame, radius: Column) -> DataFrame:
    """The rings' edges as mask segments: a buffered polygon is the polygon plus these."""
    return rings.select("mask_id", radius.alias("radius"), F.explode(edges(c("pts"))).alias("x")).select(
        "mask_id", "radius", c("x.a.e").alias("ax"), c("x.a.n").alias("ay"), c("x.b.e").alias("bx"), c("x.b.n").alias("by")
    )


def _levels(points: DataFrame, targets: DataFrame, finest: float) -> list[int]:
    """Every ``STEP``-th level, up to one whose cells are as wide as the points and targets
    lie apart."""
    both = points.select("e", "n").unionByName(targets.select("e", "n"))
    both = both.filter("abs(e) < double('inf') and abs(n) < double('inf')")
    row = both.agg((F.max("e") - F.min("e")).alias("w"), (F.max("n") - F.min("n")).alias("h")).first()
    most = max(0, math.ceil(math.log2(max(row["w"] or 0.0, row["h"] or 0.0, finest) / finest)))
    return list(range(0, most + STEP, STEP))


def _at_levels(e: Column, n: Column, levels: list[int], finest: float) -> Column:
    return F.array(*[
        F.struct(F.lit(k).alias("lv"), cell_of(e, finest * 2**k).alias("cx"), cell_of(n, finest * 2**k).alias("cy")) for k in levels
    ])


def _parts(leveled: DataFrame, cells: DataFrame) -> DataFrame:
    """(lv, cx, cy, parts, e0, n0, e1, n1): what a cell is made of, each with its box, and
    the box around these.

    Of a cell with at most ``LEAF`` targets the parts are the targets; of a larger one its
    occupied cells a level below. The targets of a crowded finest cell are dealt out to
    several rows.
    """
    key = ["lv", "cx", "cy"]
    up = F.lit(STEP)
    below = cells.select(
        (c("lv") + up).alias("lv"), F.shiftright("cx", STEP).alias("cx"), F.shiftright("cy", STEP).alias("cy"),
        F.struct("e0", "n0", "e1", "n1", c("lv").alias("lv"), c("cx").alias("cx"), c("cy").alias("cy")).alias("part"))
    large = cells.filter((c("lv") > 0) & (c("count") > LEAF)).select(*key)
    around_all = [F.min("part.e0").alias("e0"), F.min("part.n0").alias("n0"), F.max("part.e1").alias("e1"), F.max("part.n1").alias("n1")]
    # Lists are collected after the rows are dealt out: before that, few tasks of the scan would sort them all.
    below = dealt(below.join(large, key), *key).groupBy(*key).agg(F.collect_list("part").alias("parts"), *around_all)
    rest = cells.filter((c("lv") == 0) | (c("count") <= LEAF)).select(*key, F.ceil(c("count") / LEAF).alias("rows"))
    one = F.struct(
        c("te").alias("e0"), c("tn").alias("n0"), c("te").alias("e1"), c("tn").alias("n1"),
        F.lit(None).cast("int").alias("lv"), F.lit(None).cast("bigint").alias("cx"), F.lit(None).cast("bigint").alias("cy"))
    # By its input ``leveled`` looks small, however many levels are made of it: never sent to all tasks.
    last = leveled.join(rest.hint("merge"), key).select(*key, F.pmod(F.xxhash64("te", "tn"), "rows").alias("row"), one.alias("part"))
    last = dealt(last, *key, "row").groupBy(*key, "row")
    return below.unionByName(last.agg(F.collect_list("part").alias("parts"), *around_all).drop("row"))


def _least_and_most(x: Column) -> tuple[Column, Column]:
    """The least distance from (e, n) to a tight box, and one within which it has a target:
    each side of the box touches one."""
    e, n = c("e"), c("n")
    least = F.hypot(F.greatest(x["e0"] - e, e - x["e1"], F.lit(0.0)), F.greatest(x["n0"] - n, n - x["n1"], F.lit(0.0)))
    near_e, far_e = F.least(F.abs(e - x["e0"]), F.abs(e - x["e1"])), F.greatest(F.abs(e - x["e0"]), F.abs(e - x["e1"]))
    near_n, far_n = F.least(F.abs(n - x["n0"]), F.abs(n - x["n1"])), F.greatest(F.abs(n - x["n0"]), F.abs(n - x["n1"]))
    return least, F.least(F.hypot(near_e, far_n), F.hypot(far_e, near_n))


def _descended(state: DataFrame, parts: DataFrame) -> DataFrame:
    """One row (id, e, n, bound, distance, lv, cx, cy) for each part of a point's cells that
    may hold its nearest target; a row with a cell of no level where there is none."""
    key = ["lv", "cx", "cy"]
    reach = c("bound") * (1 + 1e-12)
    box = F.struct("e0", "n0", "e1", "n1")
    rows = state.join(parts, key, "left").select(
        "id", "e", "n", "bound", "distance", F.posexplode_outer(F.when(_least_and_most(box)[0] <= reach, c("parts"))).alias("at", "x"))
    least, most = _least_and_most(c("x"))
    rows = rows.select("id", "e", "n", "bound", "distance", "at", "x", least.alias("least"), most.alias("most"))
    # The first part stands for its cell, so that no point is lost.
    rows = rows.filter((c("least") <= reach) | (F.coalesce("at", F.lit(0)) == 0))
    cell = F.struct("least", c("x.lv").alias("lv"), c("x.cx").alias("cx"), c("x.cy").alias("cy"))
    rows = rows.groupBy("id", "e", "n").agg(
        F.min(F.least("bound", "most")).alias("bound"),
        F.min(F.least("distance", F.when(c("x").isNotNull() & c("x.lv").isNull(), c("least")))).alias("distance"),
        F.collect_list(F.when(c("x.lv").isNotNull(), cell)).alias("cells"))
    rows = rows.withColumn("cells", F.filter("cells", lambda x: x["least"] <= reach))
    rows = rows.select("id", "e", "n", "bound", "distance", F.inline_outer("cells")).drop("least")
    return rows.withColumns({
        "lv": F.coalesce("lv", F.lit(-1)), "cx": F.coalesce("cx", F.xxhash64("e", "n")), "cy": F.coalesce("cy", F.lit(0))})


def nearest_distance(points: DataFrame, targets: DataFrame, finest: float = 1.0) -> DataFrame:
    """(id, distance) from points (id, e, n) to the nearest target (e, n), exactly.

    Branch and bound over a pyramid of cells. The closest of one target each from a
    point's own cells is a first bound; on a level whose cells are at least that wide,
    every nearer target lies in the 3x3 neighbourhood. From there points descend: of the
    occupied parts of their cells they keep those that are no farther than the bound, and
    each part's box makes the bound smaller. The top level's cells are as wide as all the
    data, so every point has its target, however far. All levels descend in one round; there
    are as many as cells of more than ``LEAF`` targets lie in each other. No target: no row.
    """
    levels = _levels(points, targets, finest)
    spots = dealt(targets.select(c("e").alias("te"), c("n").alias("tn")), "te", "tn").distinct()
    leveled = spots.select("te", "tn", F.inline(_at_levels(c("te"), c("tn"), levels, finest)))
    cells = written(leveled.groupBy("lv", "cx", "cy").agg(
        F.count(F.lit(1)).alias("count"), F.min("te").alias("e0"), F.min("tn").alias("n0"), F.max("te").alias("e1"),
        F.max("tn").alias("n1"), F.min(F.struct("te", "tn")).alias("one")), "nearest-cells")
    bound = (
        points.select("id", "e", "n", F.inline(_at_levels(c("e"), c("n"), levels, finest)))
        .join(cells.select("lv", "cx", "cy", "one"), ["lv", "cx", "cy"], "left")
        .groupBy("id", "e", "n")
        .agg(F.min(F.hypot(c("one.te") - c("e"), c("one.tn") - c("n"))).alias("bound"))
    )
    # Without any target in its own cells a point searches the top level.
    level = F.coalesce(*[F.when(c("bound") <= finest * 2**k, F.lit(k)) for k in levels], F.lit(levels[-1]))
    width = F.lit(finest) * F.pow(F.lit(2.0), c("lv"))
    search = bound.withColumn("lv", level).select(
        "id", "e", "n", F.coalesce("bound", F.lit(math.inf)).alias("bound"), F.lit(None).cast("double").alias("distance"), "lv",
        F.inline(around(F.floor(c("e") / width), F.floor(c("n") / width), "cx", "cy")))
    search = written(search, "nearest-search")
    starts = {row["lv"] for row in search.select("lv").distinct().collect()}
    split = {row["lv"] for row in cells.filter((c("count") > LEAF) & (c("lv") > 0)).select("lv").distinct().collect()}
    parts = written(_parts(leveled, cells), "nearest-parts")
    state = search
    while starts:
        state = _descended(state, parts)
        starts = {k - STEP for k in starts & split}
    return state.filter("distance is not null").groupBy("id").agg(F.min("distance").alias("distance"))
