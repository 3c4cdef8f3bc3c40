import math
import random

import pytest
from pyspark.sql import functions as F

from terrakit.functions import shapes
from terrakit.operators import spatial
from terrakit.plans import areas

c = F.col
POLYS = "mask_id int, poly long, ring int, pts array<struct<e:double,n:double>>"


def inside(p, ring):
    hit = False
    for (ae, an), (be, bn) in zip(ring, ring[-1:] + ring[:-1]):
        if (an > p[1]) != (bn > p[1]) and p[0] < (be - ae) * (p[1] - an) / (bn - an) + ae:
            hit = not hit
    return hit


def gap(p, s):
    ax, ay, bx, by = s
    span = (bx - ax) ** 2 + (by - ay) ** 2
    t = 0 if span == 0 else min(max(((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / span, 0), 1)
    return math.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay))


def star(corners, seed, e=50.0, n=50.0):
    rng = random.Random(seed)
    turn = [2 * math.pi * k / corners for k in range(corners)]
    return [(e + rng.uniform(10, 45) * math.cos(a), n + rng.uniform(10, 45) * math.sin(a)) for a in turn]


def cloud(size, seed=5, span=110.0):
    """Half of all points sit in one small place."""
    rng = random.Random(seed)
    spread = [(rng.uniform(-5, span), rng.uniform(-5, span)) for _ in range(size // 2)]
    return spread + [(rng.uniform(48, 52), rng.uniform(48, 52)) for _ in range(size // 2)]


def points_df(spark, points):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, e double, n double")


@pytest.mark.parametrize("size", [3.0, 17.0, 400.0])
@pytest.mark.parametrize("edge_limit", [0, 5, 20000])
def test_polygons_with_holes(spark, size, edge_limit):
    outer, hole, other = star(40, 1), star(15, 2, 50.0, 50.0), star(9, 3, 70.0, 30.0)
    hole = [(50 + (e - 50) * 0.2, 50 + (n - 50) * 0.2) for e, n in hole]
    shapes_ = spark.createDataFrame([(1, 1, 0, outer), (1, 1, 1, hole), (2, 7, 0, other)], POLYS)
    spots = cloud(400)
    got = {(r.mask_id, r.id) for r in spatial.in_polygons(points_df(spark, spots), shapes_, size, edge_limit=edge_limit).collect()}
    want = {(1, i) for i, p in enumerate(spots) if inside(p, outer) and not inside(p, hole)}
    want |= {(2, i) for i, p in enumerate(spots) if inside(p, other)}
    assert got == want and want


@pytest.mark.parametrize("size", [0.7, 3.0, 5.0, 40.0])
@pytest.mark.parametrize("edge_limit", [0, 20000])
def test_points_on_edges_and_corners(spark, size, edge_limit):
    # Level and upright edges, on and off the cell borders, and a hole.
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    hole = [(2.0, 3.0), (7.0, 3.0), (7.0, 8.0), (2.0, 8.0), (2.0, 3.0)]
    grid = [(float(x), float(y)) for x in range(-1, 12) for y in range(-1, 12)]
    grid += [(x + 0.5, y + 0.5) for x, y in grid]
    df = spark.createDataFrame([(1, 1, 0, square), (1, 1, 1, hole)], POLYS)
    got = {r.id for r in spatial.in_polygons(points_df(spark, grid), df, size, edge_limit=edge_limit).collect()}
    assert got == {i for i, p in enumerate(grid) if inside(p, square) and not inside(p, hole)}


@pytest.mark.parametrize("radius", [0.5, 6.0, 40.0])
@pytest.mark.parametrize("limit", [0, 5000])
def test_within_distance(spark, radius, limit):
    rng = random.Random(8)
    lines = [tuple(rng.uniform(0, 100) for _ in range(4)) for _ in range(20)] + [(50.0, 50.0, 50.0, 50.0)] * 30
    df = spark.createDataFrame(lines, "ax double, ay double, bx double, by double")
    spots = cloud(400, span=150.0)
    got = {r.id for r in spatial.within_distance(points_df(spark, spots), df, radius, crowd=limit).collect()}
    assert got == {i for i, p in enumerate(spots) if any(gap(p, s) <= radius for s in lines)}


def test_nearest_is_exact(spark):
    targets = cloud(150, seed=2, span=5000.0) + [(200000.0, 90000.0)]
    spots = cloud(150, seed=9, span=90000.0) + [(-300000.0, 0.0)]
    df = spark.createDataFrame(targets, "e double, n double")
    got = {r.id: r.distance for r in spatial.nearest_distance(points_df(spark, spots), df, finest=10.0).collect()}
    for i, p in enumerate(spots):
        assert got[i] == pytest.approx(min(math.hypot(p[0] - e, p[1] - n) for e, n in targets))


@pytest.mark.parametrize("points_at", ["far", "beside"])
def test_nearest_in_a_cluster(spark, points_at):
    # All targets in one cell of 1 km, three of them in one of 1 m; copies; points on targets.
    rng = random.Random(3)
    targets = [(rng.uniform(0, 1000), rng.uniform(0, 1000)) for _ in range(3000)] + [(500.0 + i / 200, 500.5) for i in range(150)]
    away = 100_000.0 if points_at == "far" else 300.0
    spots = [(away + rng.uniform(0, 1000), rng.uniform(-500, 1500)) for _ in range(120)] + targets[:5] + [(500.2, 500.4)]
    df = spark.createDataFrame(targets + targets[:50], "e double, n double")
    seen = []
    descended = spatial._descended

    def counted(state, parts):
        out = descended(state, parts)
        seen.append(out.count())
        return out

    spatial._descended = counted
    try:
        got = {r.id: r.distance for r in spatial.nearest_distance(points_df(spark, spots), df).collect()}
    finally:
        spatial._descended = descended
    assert len(got) == len(spots)
    for i, p in enumerate(spots):
        assert got[i] == min(math.hypot(p[0] - e, p[1] - n) for e, n in targets) or got[i] == pytest.approx(
            min(math.hypot(p[0] - e, p[1] - n) for e, n in targets), rel=1e-15)
    assert max(seen) <= 12 * len(spots)


def test_nearest_without_rows(spark):
    none = spark.createDataFrame([], "e double, n double")
    some = spark.createDataFrame([(1.0, 2.0)], "e double, n double")
    assert spatial.nearest_distance(points_df(spark, [(0.0, 0.0)]), none).count() == 0
    assert spatial.nearest_distance(points_df(spark, [(0.0, 0.0)]).limit(0), some).count() == 0
    assert spatial.nearest_distance(points_df(spark, [(1.0, 2.0)]), some).first().distance == 0.0


@pytest.mark.parametrize("crowd", [0, 1000])
def test_corridor_has_round_ends_and_single_points_are_discs(spark, crowd):
    table = spark.createDataFrame(
        [(1, 0, "corridor", 0.0, 0.0, 0.0, 0.005, [(0.0, 0.0), (10.0, 0.0)]), (2, 0, "corridor", 0.0, 0.0, 0.0, 0.005, [(50.0, 50.0)]),
         (3, 0, "circle", 80.0, 80.0, 0.005, 0.0, [])],
        "area_id int, part int, kind string, e double, n double, radius_km double, buffer_km double, points array<struct<e:double,n:double>>")
    spots = [(-4.9, 0.0), (-4.0, 4.0), (5.0, 4.9), (5.0, 5.1), (50.0, 54.9), (55.1, 50.0), (80.0, 84.9)]
    got = {(r.mask_id, r.id) for r in spatial.near_segments(points_df(spark, spots), areas.mask_segments(table), size=3.0, crowd=crowd).collect()}
    assert got == {(1, 0), (1, 2), (2, 4), (3, 6)}


def test_unmasked_part_unmasks_the_union(spark):
    table = spark.createDataFrame(
        [(1, 0, "circle", 5.0, 5.0, 1.0, 0.0), (1, 1, "place", 5000.0, 5.0, 1.0, 0.0), (2, 0, "circle", 5.0, 5.0, 1.0, 0.0)],
        "area_id int, part int, kind string, e double, n double, radius_km double, buffer_km double")
    table = table.withColumn("points", F.expr(shapes.EMPTY)).withColumns({k: F.lit(0.0) for k in ("min_e", "min_n", "max_e", "max_n")})
    got = {r.area_id: r for r in areas.extents(table).collect()}
    assert not got[1].masked and got[2].masked and got[1].max_e == 6000.0


def test_unit_masks(spark):
    def square(e, n, side):
        return [(e, n), (e + side, n), (e + side, n + side), (e, n + side)]

    units = spark.createDataFrame(
        [("commune", 1, "CH", "Gemeindegebiet", 0, 0, square(0.0, 0.0, 1000.0)),
         ("commune", 2, "CH", "Kantonsgebiet", 1, 0, square(5000.0, 0.0, 1000.0)),
         ("commune", 3, "LI", "Gemeindegebiet", 2, 0, square(9000.0, 0.0, 1000.0)),
         ("canton", 1, "CH", None, 3, 0, square(0.0, 0.0, 4000.0)),
         ("canton", 1, "CH", None, 3, 1, square(2000.0, 2000.0, 500.0)),
         ("canton", None, "CH", None, 4, 0, None)],
        "level string, number int, icc string, objektart string, poly int, ring int, pts array<struct<e:double,n:double>>")
    parts = spark.createDataFrame(
        [(1, 0, "adminUnits", "commune", [1, 1], 0.0), (1, 1, "adminUnits", "commune", [1], 0.5),
         (2, 0, "adminUnits", "commune", [2, 3], 0.0), (3, 0, "adminUnits", "canton", [1], None),
         (4, 0, "adminUnits", "canton", None, 1.0), (5, 0, "place", None, [1], 1.0)],
        "area_id int, part int, kind string, level string, numbers array<bigint>, buffer_km double")
    points = spark.createDataFrame(
        [(1, 500.0, 500.0), (2, 1400.0, 500.0), (3, 2200.0, 2200.0), (4, 3900.0, 3900.0), (5, 5500.0, 500.0)],
        "id int, e double, n double")
    rings, band, unknown = areas.unit_masks(parts, units)
    got = {(r.mask_id, r.id) for r in spatial.members(points, rings, band, 1000.0).collect()}
    assert got == {(1, 1), (1, 2), (3, 1), (3, 2), (3, 4)}
    assert {(r.area_id, r.reason) for r in unknown.collect()} == {
        (2, "no_such_unit level=commune numbers=2,3"), (4, "no_such_unit level=canton numbers=")}
    none = areas.unit_masks(parts.limit(0), units)
    assert [x.count() for x in none] == [0, 0, 0]


def scans_of(df, table):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count(f"/{table}.parquet")


def test_points_are_read_once(spark):
    """However many kinds of cells a mask has, one join looks them all up."""
    from terrakit.registry import all_queries

    for name in ("d2_points_in_polygons", "d3_points_near_routes", "d4_buffered_polygons"):
        assert scans_of(all_queries()[name](spark, "/root/testdata/sf0.001"), "customer") == 1, name


def test_mask_rows_follow_edges_not_area(spark):
    turn = [(2 * math.pi * k / 5000, 400 * (1 + 0.1 * math.sin(k / 40))) for k in range(5000)]
    ring = [(500 + r * math.cos(a), 500 + r * math.sin(a)) for a, r in turn]
    cells = spatial.polygon_cells(spark.createDataFrame([(1, 1, 0, ring)], POLYS), 1.0).cache()
    touched = cells.filter("not full").count()
    assert touched < 7000 and cells.count() < 8 * touched  # of half a million cells
    square = [(0.0, 0.0), (4000.0, 0.0), (4000.0, 4000.0), (0.0, 4000.0)]
    big = spatial.polygon_cells(spark.createDataFrame([(1, 1, 0, square)], POLYS), 1.0)
    assert big.count() < 400_000  # of 16 million cells


def test_touching_rings_and_nested_holes(spark):
    outer = [(0.0, 0.0), (60.0, 0.0), (60.0, 60.0), (0.0, 60.0)]
    holes = [[(10.0, 10.0), (40.0, 10.0), (40.0, 40.0), (10.0, 40.0)], [(20.0, 20.0), (50.0, 20.0), (50.0, 50.0), (20.0, 50.0)],
             [(25.0, 0.0), (30.0, 5.0), (25.0, 5.0)]]
    island = [(22.0, 22.0), (38.0, 22.0), (30.0, 38.0)]
    df = spark.createDataFrame([(1, 1, 0, outer)] + [(1, 1, k, h) for k, h in enumerate(holes, 1)] + [(1, 2, 0, island)], POLYS)
    spots = cloud(1500, seed=13, span=70.0) + [(float(x), float(y)) for x in range(0, 61, 5) for y in range(0, 61, 5)]
    for size in (0.9, 4.0, 10.0, 33.0):
        got = {(r.poly, r.id) for r in spatial.in_polygons(points_df(spark, spots), df, size).collect()}
        want = {(1, i) for i, p in enumerate(spots) if inside(p, outer) and not any(inside(p, h) for h in holes)}
        assert got == want | {(2, i) for i, p in enumerate(spots) if inside(p, island)}


def test_targets_on_all_levels_are_never_broadcast(spark, monkeypatch):
    """Rows for each level are made from few targets and look as small as these."""
    import contextlib
    import io

    plans, write = [], spatial.written

    def kept(df, label):
        out = write(df, label)
        with contextlib.redirect_stdout(io.StringIO()) as text:
            df.explain()
        plans.append((label, text.getvalue()))
        return out

    monkeypatch.setattr(spatial, "written", kept)
    spots = points_df(spark, [(float(k * 37 % 1009), float(k * 91 % 1013)) for k in range(400)])
    assert spatial.nearest_distance(spots, spots.select("e", "n")).filter("distance <> 0").count() == 0
    plan = dict(plans)["nearest-parts"]
    last = plan[plan.index("Union"):]
    assert "SortMergeJoin" in last
