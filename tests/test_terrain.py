"""Surfaces with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from terrakit.operators import chain, contours, terrain

c = F.col


def surface(spark, cols, rows, height):
    cells = [(x, y, float(height(x, y))) for y in range(rows) for x in range(cols)]
    return spark.createDataFrame(cells, "c int, r int, z double")


def lines(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.i):
        out.setdefault((r.line, r.level, r.closed), []).append((r.e, r.n))
    return out


def traced(grid, interval, block=16):
    return chain.chain_directed(terrain.march(terrain.cells2x2(grid, block), terrain.interval_levels(interval)))


def test_plane_gives_straight_lines(spark):
    got = lines(traced(surface(spark, 60, 40, lambda x, y: x), 20))
    assert sorted(k[1] for k in got) == [20, 40]
    for (_, level, closed), pts in got.items():
        assert not closed and len(pts) == 40
        # A sample exactly on the level belongs to the high side.
        assert {p[0] for p in pts} == {float(level)}
        steps = {round(b[1] - a[1]) for a, b in zip(pts, pts[1:])}
        assert steps in ({1}, {-1})


@pytest.mark.parametrize("block", [7, 16, 500])
def test_cone_gives_one_ring_per_level(spark, block):
    grid = surface(spark, 61, 61, lambda x, y: 60.3 - math.hypot(x - 30, y - 30))
    got = lines(traced(grid, 10, block))
    inner = {k: v for k, v in got.items() if k[1] >= 40}
    assert sorted(k[1] for k in inner) == [40, 50, 60]
    for (_, level, closed), pts in inner.items():
        assert closed and pts[0] == pts[-1] and len(set(pts)) == len(pts) - 1
        radius = [math.hypot(e - 30, n - 30) for e, n in pts]
        assert max(abs(r - (60.3 - level)) for r in radius) < 0.3


def test_every_segment_is_used_once(spark):
    grid = surface(spark, 50, 50, lambda x, y: 30 * math.sin(x / 4) * math.cos(y / 5) + (x * 7 + y * 13) % 5)
    seg = terrain.march(terrain.cells2x2(grid, 16), terrain.interval_levels(5))
    got = lines(chain.chain_directed(seg))
    assert sum(len(p) - 1 for p in got.values()) == seg.count()
    assert all(p[0] == p[-1] for k, p in got.items() if k[2])


def test_saddle_lines_do_not_cross(spark):
    for corners, shape in (((10, 0, 0, 10), 5), ((0, 10, 10, 0), 10)):
        sw, se, nw, ne = corners
        grid = spark.createDataFrame([(0, 0, sw), (1, 0, se), (0, 1, nw), (1, 1, ne)], "c int, r int, z int").withColumn("z", c("z").cast("double"))
        for level in (4, 6):
            seg = terrain.march(terrain.cells2x2(grid), F.array(F.lit(level))).collect()
            assert len(seg) == 2 and {s["case"] for s in seg} == {shape}
            (a, b), (p, q) = [((s.ae, s.an), (s.be, s.bn)) for s in seg]

            def side(o, x, y):
                return (x[0] - o[0]) * (y[1] - o[1]) - (x[1] - o[1]) * (y[0] - o[0])

            crossing = side(a, b, p) * side(a, b, q) < 0 and side(p, q, a) * side(p, q, b) < 0
            assert not crossing


def test_voids_flat_ground_and_single_samples(spark):
    flat = surface(spark, 10, 10, lambda x, y: 500)
    assert terrain.march(terrain.cells2x2(flat), terrain.interval_levels(20)).count() == 0
    void = surface(spark, 10, 10, lambda x, y: -9999)
    assert terrain.march(terrain.cells2x2(void), terrain.interval_levels(20)).count() == 0
    hole = surface(spark, 10, 10, lambda x, y: -9999 if (x, y) == (5, 5) else 505)
    assert terrain.march(terrain.cells2x2(hole), terrain.interval_levels(10)).count() == 0


@pytest.mark.parametrize("angle", [10, 30, 45, 60])
def test_ramp_has_its_angle(spark, angle):
    rise = math.tan(math.radians(angle)) * 2.0
    grid = surface(spark, 60, 40, lambda x, y: x * rise)
    field = terrain.slope_field(grid, 10.0)
    inner = field.filter("c between 1 and 10 and r between 1 and 6")
    assert inner.agg(F.max(F.abs(c("degrees") - angle))).first()[0] < 0.5
    assert field.count() == 12 * 8


def test_slope_areas_close_and_small_ones_go(spark):
    def tilt(x, y):
        return 41.0 if (5 <= x < 15 and 5 <= y < 12) or (x, y) == (20, 20) else 5.0

    cells = [(x, y, tilt(x, y)) for y in range(30) for x in range(30)]
    field = spark.createDataFrame(cells, "c int, r int, degrees double")
    rows = contours.slope_areas(field).collect()
    assert {r.min_deg for r in rows} == {30, 35, 40}
    for line in {r.line for r in rows}:
        pts = [(r.e, r.n) for r in sorted((r for r in rows if r.line == line), key=lambda r: r.i)]
        assert pts[0] == pts[-1] and len(pts) >= 4
    edge = spark.createDataFrame([(x, y, 50.0) for x in range(6) for y in range(6)], "c int, r int, degrees double")
    # Steep ground up to the border still closes.
    assert contours.slope_areas(edge).select("line").distinct().count() == 5


def test_contours_are_simplified_and_graded(spark):
    grid = surface(spark, 80, 80, lambda x, y: 150.5 - math.hypot(x - 40, y - 40) * 2)
    got = contours.contour_lines(grid, 20, simplify_m=1.0)
    rows = got.select("line", "level", "tier").distinct().collect()
    assert {(r.level, r.tier) for r in rows} >= {(100, "elevation_major"), (120, "elevation_minor")}
    raw = traced(grid, 20).count()
    assert got.count() < raw * 0.7


def test_levels_below_zero(spark):
    grid = surface(spark, 4, 4, lambda x, y: -30.7 + x * 10)
    r = terrain.levels_scanned(grid, 20).first()
    assert (r["first"], r["last"], r["levels"]) == (-40, 0, 3)


def test_chain_any_pairs_every_end(spark):
    # A figure of eight through one place, a closed square, and an open line given backwards.
    segs = [(0, 0, 5, 5), (5, 5, 10, 0), (10, 0, 10, 10), (10, 10, 5, 5), (5, 5, 0, 10), (0, 10, 0, 0),
            (20, 0, 21, 0), (21, 1, 21, 0), (21, 1, 20, 1), (20, 1, 20, 0), (31, 0, 30, 0), (31, 0, 32, 0.0004)]
    df = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(segs)], "sid long, ae double, an double, be double, bn double")
    rows = chain.chain_any(df).collect()
    assert sorted(r.sid for r in rows) == list(range(len(segs)))
    for line in {r.line for r in rows}:
        path = sorted((r for r in rows if r.line == line), key=lambda r: r.i)
        ends = [(segs[r.sid][2:] + segs[r.sid][:2] if r.reversed else segs[r.sid]) for r in path]
        assert all(a[2:] == b[:2] for a, b in zip(ends, ends[1:]))
        if path[0].closed:
            assert ends[-1][2:] == ends[0][:2]
    assert len({r.line for r in rows if r.sid >= 10}) == 1


def test_list_rank_long_line_and_rings(spark):
    nodes = [(i, i - 1 if i else None, 2) for i in range(300)] + [(1000 + i, 1000 + (i - 1) % 7, 1) for i in range(7)] + [(2000, 2000, 1)]
    got = {r.h: r for r in chain.list_rank(spark.createDataFrame(nodes, "h long, prev long, size int")).collect()}
    assert all((got[i].chain, got[i].before, got[i].closed) == (0, 2 * i, False) for i in range(300))
    assert [got[1000 + i].before for i in range(7)] == list(range(7)) and got[1003].closed
    assert got[2000].closed and got[2000].before == 0


def test_list_rank_over_many_ranges(spark, monkeypatch):
    """Lines and rings across ranges come out as one walk from the head or the smallest h,
    and lines that stay together in a range take no rounds over all nodes."""
    import random

    dice = random.Random(5)
    names = dice.sample(range(-10_000, 10_000), 900)
    size = {h: dice.randint(1, 4) for h in names}
    prev, want, at = {}, {}, 0
    for length in (300, 1, 2, 40, 250, 7, 90, 60, 150):
        part, at = names[at:at + length], at + length
        if length in (60, 90):  # near each other, so that they lie in one range
            part.sort()
        closed = length in (2, 250, 7, 90)
        if closed:
            low = part.index(min(part))
            part = part[low:] + part[:low]
        before = 0
        for k, h in enumerate(part):
            prev[h] = part[k - 1] if k or closed else None
            want[h] = (part[0], before, closed)
            before += size[h]
    df = spark.createDataFrame([(h, prev[h], size[h]) for h in prev], "h long, prev long, size int")
    for limit in (10_000, 100):
        assert {r.h: (r.chain, r.before, r.closed) for r in chain.list_rank(df, limit).collect()} == want, limit
    line = spark.range(5000).select(F.col("id").alias("h"), F.when(F.col("id") > 0, F.col("id") - 1).alias("prev"), F.lit(1).alias("size"))
    monkeypatch.setattr(chain, "_doubled", None)
    assert chain.list_rank(line, 300).filter("before = h and chain = 0 and not closed").count() == 5000


def test_tiles_and_samples_give_the_same_segments(spark):
    px = 6

    def height(x, y):
        return -9999.0 if (x, y) == (8, 9) else 200 + 60 * math.sin(x / 3) * math.cos(y / 4)

    tiles = [
        (e, n, [height(e * px + k % px, n * px + px - 1 - k // px) for k in range(px * px)])
        for e in range(7) for n in range(6) if (e, n) != (3, 3)]
    df = spark.createDataFrame(tiles, "e_km int, n_km int, samples array<double>")

    def key(seg):
        return sorted(tuple(r) for r in seg.select("sid", "level", "case", "ak", "bk", "ae", "an", "be", "bn").collect())

    slow = terrain.march(terrain.cells2x2(terrain.mosaic(df, px), 16), terrain.interval_levels(20))
    fast = terrain.march(terrain.tile_cells(df, 20, px, per_block=2), terrain.interval_levels(20))
    assert key(slow) == key(fast) and key(fast)


def test_edge_numbers_never_meet(spark):
    from terrakit.operators.terrain import _edge_key

    rows = [(10, 5_280_000, 7), (11, 1_085_696, 7), (10, -5_280_000, 7), (10, 5_280_000, -8_000_000), (-8000, 0, 0), (4800, 8_388_607, 8_388_607)]
    df = spark.createDataFrame(rows, "level int, x long, y long")
    keys = [r.k for v in (0, 1) for r in df.select(_edge_key(v, F.col("x"), F.col("y")).alias("k")).collect()]
    assert len(set(keys)) == 2 * len(rows)
    far = spark.createDataFrame([(10, 8_388_608, 0)], "level int, x long, y long")
    with pytest.raises(Exception, match="does not fit"):
        far.select(_edge_key(0, F.col("x"), F.col("y"))).collect()
