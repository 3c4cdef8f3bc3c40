import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakit.functions import attrs, projection, shapes
from terrakit.operators import simplify
from terrakit.sources.osm import emit_elements

# Ten positions from an exact projection (easting, northing, lon, lat).
TRUTH = [
    (2600000.0, 1200000.0, 7.4386324, 46.9510828), (2602030.7, 1191775.0, 7.4652723, 46.8770944),
    (2645921.0, 1163748.0, 8.0382085, 46.6234077), (2679500.0, 1212200.0, 8.4850291, 47.0560594),
    (2500300.0, 1117300.0, 6.1469901, 46.1997555), (2762300.0, 1180500.0, 9.5631667, 46.7559112),
    (2825000.0, 1108000.0, 10.3480799, 46.0859609), (2495000.0, 1290000.0, 6.0383577, 47.7521192),
    (2611000.0, 1267000.0, 7.5847592, 47.5536254), (2837000.0, 1160000.0, 10.5295784, 46.5492660),
]
c = F.col


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def pts(*pairs):
    return F.array(*[shapes.point(F.lit(float(e)), F.lit(float(n))) for e, n in pairs])


def test_projection_truth(spark):
    df = spark.createDataFrame(TRUTH, "e double, n double, lon double, lat double")
    lon, lat = projection.to_wgs84(c("e"), c("n"))
    e, n = projection.to_lv95(lon, lat)
    for r in df.select("*", lon.alias("x"), lat.alias("y"), e.alias("e2"), n.alias("n2")).collect():
        metres = math.hypot((r.x - r.lon) * 111320 * math.cos(math.radians(r.lat)), (r.y - r.lat) * 111320)
        inside = 2550000 <= r.e <= 2800000 and 1100000 <= r.n <= 1270000
        assert metres < (1.5 if inside else 5.0)
        assert math.hypot(r.e2 - r.e, r.n2 - r.n) < 5.0


def test_areas_and_centroids(spark):
    square = pts((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    hole = pts((2, 2), (4, 2), (4, 4), (2, 4), (2, 2))
    assert one(spark, shapes.signed_area(square)) == 100
    assert one(spark, shapes.signed_area(F.reverse(square))) == -100
    assert one(spark, shapes.polygon_area(F.array(square, hole))) == 96
    assert one(spark, shapes.polygon_area(F.array(hole, square))) == 0
    m = one(spark, shapes.centroid(pts((0, 0), (4, 0), (4, 2), (0, 2))))
    assert (m["e"], m["n"]) == (2, 1)
    flat = one(spark, shapes.centroid(pts((0, 0), (3, 0), (6, 0))))
    assert (flat["e"], flat["n"]) == (3, 0)
    assert one(spark, shapes.centroid(pts((0, 0), (3, 0)))) is None


@pytest.mark.parametrize("e,n,inside", [(1, 1, True), (3, 3, False), (11, 5, False), (5, 5, True), (-1, 5, False)])
def test_point_in_polygon(spark, e, n, inside):
    square = pts((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    hole = pts((2, 2), (4, 2), (4, 4), (2, 4), (2, 2))
    assert one(spark, shapes.in_polygon(F.lit(float(e)), F.lit(float(n)), F.array(square, hole))) is inside


def clip(spark, points):
    parts = one(spark, shapes.clip_line(points, *[F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)]))
    return [[(p["e"], p["n"]) for p in part] for part in parts]


def test_clip_line(spark):
    assert clip(spark, pts((-5, 5), (15, 5))) == [[(0, 5), (10, 5)]]
    assert clip(spark, pts((1, 1), (2, 2), (3, 3))) == [[(1, 1), (2, 2), (3, 3)]]
    # Out and back in: two parts.
    assert clip(spark, pts((5, 5), (15, 5), (15, 8), (5, 8))) == [[(5, 5), (10, 5)], [(10, 8), (5, 8)]]
    assert clip(spark, pts((-5, -5), (-1, 20))) == []
    assert clip(spark, pts((20, 5), (30, 5))) == []


def test_clip_ring(spark):
    def ring(*pairs):
        out = one(spark, shapes.clip_ring(pts(*pairs), *[F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)]))
        return [(p["e"], p["n"]) for p in out]

    cut = ring((-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5))
    assert cut[0] == cut[-1] and set(cut) == {(0, 0), (5, 0), (5, 5), (0, 5)}
    assert ring((20, 20), (30, 20), (30, 30), (20, 20)) == []
    around = ring((-5, -5), (15, -5), (15, 15), (-5, 15), (-5, -5))
    assert set(around) == {(0, 0), (10, 0), (10, 10), (0, 10)}


def test_circle_and_closing(spark):
    disc = one(spark, shapes.circle(F.lit(100.0), F.lit(50.0), F.lit(10.0)))
    assert len(disc) == 65 and disc[0] == disc[-1]
    assert all(abs(math.hypot(p["e"] - 100, p["n"] - 50) - 10) < 1e-9 for p in disc)
    assert len(one(spark, shapes.closed(pts((0, 0), (1, 0), (1, 1))))) == 4
    assert len(one(spark, shapes.closed(pts((0, 0), (1, 0), (0, 0))))) == 3


def slow_simplify(points, tolerance):
    """Straight recursion, as the definition reads."""
    if len(points) < 3 or tolerance <= 0:
        return points
    (ae, an), (be, bn) = points[0], points[-1]
    span = (be - ae) ** 2 + (bn - an) ** 2
    best, at = -1.0, 0
    for k, (e, n) in enumerate(points[1:-1], 1):
        t = 0.0 if span == 0 else min(max(((e - ae) * (be - ae) + (n - an) * (bn - an)) / span, 0.0), 1.0)
        d = math.hypot(e - ae - t * (be - ae), n - an - t * (bn - an))
        if d > best:
            best, at = d, k
    if best <= tolerance:
        return [points[0], points[-1]]
    return slow_simplify(points[: at + 1], tolerance)[:-1] + slow_simplify(points[at:], tolerance)


def wander(size, seed):
    rng = random.Random(seed)
    e = n = 0.0
    out = []
    for _ in range(size):
        e, n = e + rng.uniform(-1, 3), n + rng.uniform(-2, 2)
        out.append((e, n))
    return out


def test_kept_vertices_match_recursion():
    tracks = [wander(size, size) for size in (1, 2, 3, 10, 200)] + [[(0.0, 0.0), (5.0, 1.0), (0.0, 0.0)]]
    flat = np.array([p for t in tracks for p in t])
    last = np.cumsum([len(t) for t in tracks]) - 1
    first = np.concatenate([[0], last[:-1] + 1])
    keep = simplify.kept_vertices(flat[:, 0], flat[:, 1], first, last, np.full(len(tracks), 2.0))
    for t, a, b in zip(tracks, first, last):
        assert [tuple(p) for p in flat[a : b + 1][keep[a : b + 1]]] == slow_simplify(t, 2.0)


def test_short_and_long_lines_simplify_alike(spark):
    rows = [(k, i, e, n) for k in (1, 2) for i, (e, n) in enumerate(wander(150 * k, k))]
    points = spark.createDataFrame(rows, "line long, i long, e double, n double")
    want = {k: slow_simplify(wander(150 * k, k), 2.0) for k in (1, 2)}
    for limit in (10_000, 200, 10):
        got = simplify.simplify_points(points, "line", 2.0, row_limit=limit).collect()
        for k in (1, 2):
            assert [(r.e, r.n) for r in sorted(got, key=lambda r: r.i) if r.line == k] == want[k]


def test_long_rings_of_one_pattern_take_few_rounds(spark, monkeypatch):
    """There and back along 40 equal waves: peeled off a wave a round they took over 40 rounds."""
    side = [(float(20 * (k % 3)), float(k)) for k in range(121)]
    ring = side + [(e + 100.0, n) for e, n in reversed(side)] + side[:1]
    calls = []
    monkeypatch.setattr(simplify, "cut_lineage", lambda df: calls.append(1) or df.checkpoint())
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getCheckpointDir() or "/tmp/spark-checkpoints")
    points = spark.createDataFrame([(1, i, e, n) for i, (e, n) in enumerate(ring)], "line long, i long, e double, n double")
    got = sorted(simplify.simplify_points(points, "line", 8.0, row_limit=150).collect(), key=lambda r: r.i)
    flat = np.array(ring)
    keep = simplify.kept_vertices(flat[:, 0], flat[:, 1], np.array([0]), np.array([len(ring) - 1]), np.array([8.0]))
    assert [r.i for r in got] == np.flatnonzero(keep).tolist()
    assert len(calls) <= 10


def test_simplify_column_keeps_other_columns_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, [(0.0, 0.0), (1.0, 0.1), (2.0, 0.0)], 1.0), (2, None, 1.0), (3, [(0.0, 0.0), (1.0, 5.0), (2.0, 0.0)], 0.0)],
        "id int, pts array<struct<e:double,n:double>>, tol double")
    got = {r.id: r.pts for r in simplify.simplify_column(df, "pts", "tol").collect()}
    assert len(got[1]) == 2 and got[2] is None and len(got[3]) == 3


def test_emitted_elements(spark):
    df = spark.createDataFrame([
        ("a", 1, "Polygon", [(0, 0, [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 0.0)]), (0, 1, [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0)])]),
        ("a", 2, "LineString", [(0, 0, [(0.0, 0.0), (0.0, 0.0)])]),
        ("a", 3, "MultiPoint", [(0, 0, [(0.0, 0.0)]), (1, 0, [(1.0, 1.0)])]),
    ], "layer string, id long, kind string, parts array<struct<poly:int,ring:int,pts:array<struct<e:double,n:double>>>>")
    rows = emit_elements(df).collect()
    ways = [r for r in rows if r.element == "way"]
    # The hole is a closed way of its own, the line without length is gone.
    assert sorted(len(r.refs) for r in ways) == [4, 4] and all(r.refs[0] == r.refs[-1] for r in ways)
    assert len([r for r in rows if r.element == "poi"]) == 2


def test_text_helpers(spark):
    assert one(spark, attrs.fold(F.lit("  Genève "))) == "geneve"
    assert one(spark, attrs.fold(F.lit("Weißenburg"))) == "weissenburg"
    assert one(spark, attrs.primary_name(F.lit("Bern | Berna | Berne"))) == "Bern"
    assert one(spark, attrs.other_names(F.lit("Bern | Berna | Berne"))) == "Berna;Berne"
    assert one(spark, attrs.other_names(F.lit("Bern"))) is None
    assert one(spark, attrs.fnv32(F.lit("abc"))) == 440920331
    assert one(spark, attrs.fnv64(F.lit("abc"))) == "e71fa2190541574b"
    assert one(spark, attrs.byte_text(F.lit(1536))) == "1.5 KB"
    assert one(spark, attrs.degree_label(F.lit(-5), F.lit(8))) == "S05E008"
    assert one(spark, attrs.number_tag(F.lit(457.0))) == "457"
    assert one(spark, attrs.number_tag(F.lit(0.5))) == "0.5"
    assert one(spark, attrs.number_tag(F.lit(0.00025))) == "0.00025"
    assert one(spark, attrs.number_tag(F.lit(12345678.25))) == "12345678.25"
    assert one(spark, attrs.number_tag(F.lit(float("nan")))) is None
    assert one(spark, attrs.postcode(F.lit("4052 Basel"))) == "4052"
    assert one(spark, attrs.locality(F.lit("Basel Stadt"))) == "Basel Stadt"


def test_without_repeats(spark):
    cases = [[], [1], [1, 1, 1], [1, 1, 2, 2, 1], [None, None, 3, 3, None], [2, 3]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)] + [(99, None)], "i int, v array<int>")
    got = {r.i: r.out for r in df.select("i", shapes.without_repeats(F.col("v")).alias("out")).collect()}
    want = [[], [1], [1], [1, 2, 1], [None, None, 3, None], [2, 3]]
    assert got == {**dict(enumerate(want)), 99: None}
