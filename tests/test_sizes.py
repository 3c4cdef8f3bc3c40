"""Plans and figures that must hold at any size."""

import random

import pytest
from pyspark.sql import functions as F

from terrakit.functions import attrs, projection
from terrakit.plans import coverage, estimate, raster
from terrakit.registry import all_queries

SF = "/root/testdata/sf0.001"


def sent_after_explode(df):
    """Broadcasts of a plan below which rows are made: their size is not known beforehand."""
    found, inside = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth <= inside:
            inside = None
        if "BroadcastExchange" in line:
            inside = depth if inside is None else inside
        elif inside is not None and "Generate" in line:
            found.append(line)
    return found


@pytest.mark.parametrize("name", [
    "d15_raster_tiles_kept", "e3_group_counts_per_area", "d11_cells_a_mask_needs", "k7_disk_need", "d5_union_masks"])
def test_made_rows_are_not_broadcast(spark, name):
    assert sent_after_explode(all_queries()[name](spark, SF)) == []


def gap_sq(e, n, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    u = 0.0 if dx == 0 and dy == 0 else min(max(((e - ax) * dx + (n - ay) * dy) / (dx * dx + dy * dy), 0.0), 1.0)
    return (e - ax - u * dx) ** 2 + (n - ay - u * dy) ** 2


def random_masks(rng, count, each, spread):
    out = []
    for mask in range(count):
        for _ in range(each):
            e, n = 2_600_000 + rng.randrange(spread), 1_200_000 + rng.randrange(spread)
            out.append((mask, rng.choice([200.0, 1000.0, 1500.0]), float(e), float(n),
                        float(e + rng.choice([0, 400, 9_000])), float(n - rng.choice([0, 1000, 7_000]))))
    return out


SEGMENTS = "mask_id long, radius double, ax double, ay double, bx double, by double"


def test_cells_of_many_segments(spark):
    segs = random_masks(random.Random(3), 4, 6, 20_000) + [(0, 1000.0, 2_604_000.0, 1_203_000.0, 2_604_000.0, 1_203_000.0)]
    boxes = [(m, 2_600_000.0 + 500 * m, 1_195_000.0, 2_621_000.0, 1_220_500.0) for m in range(5)]
    want = set()
    for m, e0, n0, e1, n1 in boxes:
        xs, ys = range(int(e0 // 1000), int(-(-e1 // 1000))), range(int(n0 // 1000), int(-(-n1 // 1000)))
        hit = {(x, y) for x in xs for y in ys if any(
            s[0] == m and gap_sq((x + dx) * 1000, (y + dy) * 1000, *s[2:]) <= s[1] ** 2 for s in segs for dx, dy in coverage.PROBES)}
        want |= {(m, x + a, y + b) for x, y in hit for a in (-1, 0, 1) for b in (-1, 0, 1) if x + a in xs and y + b in ys}
    got = coverage.cells_needed(
        spark.createDataFrame(boxes, "area_id long, min_e double, min_n double, max_e double, max_n double"), None,
        spark.createDataFrame(segs, SEGMENTS)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_tiles_of_many_segments(spark):
    segs = random_masks(random.Random(5), 3, 8, 30_000)
    tiles = []
    for m, step in enumerate((0.01, 0.05, 0.3)):
        tiles += [(m, i, j, 7.4 + j * step, 46.9 + i * step, 7.4 + (j + 1) * step, 46.9 + (i + 1) * step)
                  for i in range(4) for j in range(6 if m else 12)]
    names = "area_id long, row int, col int, west double, south double, east double, north double"
    t = spark.createDataFrame(tiles, names)
    k = F.explode(F.sequence(F.lit(0), F.lit(8)))
    probes = t.withColumn("i", k).withColumn("j", k).select("*", *[v.alias(x) for v, x in zip(projection.to_lv95(
        F.col("west") + (F.col("east") - F.col("west")) * F.col("i") / 8, F.col("south") + (F.col("north") - F.col("south")) * F.col("j") / 8), "en")])
    want = {(p.area_id, p.row, p.col) for p in probes.collect() for s in segs if s[0] == p.area_id and gap_sq(p.e, p.n, *s[2:]) <= s[1] ** 2}
    got = raster.touched(t, None, spark.createDataFrame(segs, SEGMENTS)).collect()
    assert 0 < len(want) < len(tiles)
    assert len(got) == len(want) and {(r.area_id, r.row, r.col) for r in got} == want


def test_prediction_adds_in_model_order(spark):
    """Terms first, then slopes, roads and addresses: any other order gives one byte more here."""
    row = spark.sql("""select 0L landCover, 0L water, 204L transport, 3688L built, 0L names, 0L winter, 0L cycling, 57D area_km2,
        20 contour_interval_m, 'detailed' relief, true slope_classes, true routing, true addresses, true wrist""")
    assert row.select(estimate.predict().alias("p")).first().p == 356_312


def test_fixed_rounds_by_the_exact_value(spark):
    numbers = [47.111322395, 8.763737185, 46.000000005, -0.000000015, 7.5, 1234.123456785, 2.5 / 2**9]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select(attrs.fixed(F.col("x"), 8).alias("t")).collect()
    assert [r.t for r in rows] == [f"{x:.8f}" for x in numbers]


def test_areas_are_dealt_out_before_their_text(spark):
    """One small file of areas is one task's input, but its rings are many tasks' work."""
    from terrakit.plans import areas
    from terrakit.queries.geometry import area_table
    from terrakit.registry import Tables

    text = areas.to_geojson(area_table(Tables(spark, SF)))
    assert text.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
