import random

import pytest

from terrakit.plans import counts

KEYS = "min_e double, min_n double, max_e double, max_n double"


def boxes(rng, n, spread, widest):
    out = []
    for i in range(n):
        e, m = rng.uniform(-spread, spread), rng.uniform(-spread, spread)
        w, h = rng.choice([0.0, rng.uniform(0, widest)]), rng.choice([0.0, rng.uniform(0, widest)])
        if i % 4 == 0:  # borders exactly on cells
            e, m, w, h = e // 100 * 100.0, m // 100 * 100.0, w // 100 * 100.0, h // 100 * 100.0
        out.append((e, m, e + w, m + h))
    return out


def plain(features, areas):
    found = {}
    for area, a in areas:
        for layer, f in features:
            if None not in a + f and f[2] >= a[0] and f[0] <= a[2] and f[3] >= a[1] and f[1] <= a[3]:
                found[(area, layer)] = found.get((area, layer), 0) + 1
    return found


@pytest.mark.parametrize("widest", [50.0, 900.0, 40_000.0])
def test_counts_equal_all_pairs(spark, widest):
    rng = random.Random(int(widest))
    features = [(f"layer{i % 3}", b) for i, b in enumerate(boxes(rng, 400, 2_000, widest))]
    features += [("stray", (1e9, 1e9, 1e9, 1e9)), ("stray", (-1e9, -50.0, -1e9, 50.0)), ("wide", (-90_000.0, -90_000.0, 90_000.0, 90_000.0))]
    features += [("layer0", (None, 0.0, 1.0, 1.0)), ("layer0", (0.0, 0.0, 1.0, None))]
    areas = [(i, b) for i, b in enumerate(boxes(rng, 40, 2_000, 1_500.0))] + [(900, (None, None, None, None)), (3, (0.0, 0.0, 700.0, 700.0))]
    f = spark.createDataFrame([(k, *b) for k, b in features], f"layer string, {KEYS}")
    a = spark.createDataFrame([(k, *b) for k, b in areas], f"area_id long, {KEYS}")
    got = {(r.area_id, r.layer): r.n for r in counts.counts_in_areas(f, a, size=100.0).collect()}
    assert got == plain(features, areas)


def test_inner_features_are_not_paired(spark):
    """20,000 features inside one area: only those at its rim meet the area row."""
    f = spark.range(20_000).selectExpr("'x' layer", "id % 200 * 10.0D + 5 min_e", "id div 200 * 20.0D + 5 min_n", "id % 200 * 10.0D + 6 max_e", "id div 200 * 20.0D + 6 max_n")
    a = spark.sql("select 1L area_id, 0D min_e, 0D min_n, 2000D max_e, 2000D max_n")
    assert counts.counts_in_areas(f, a, size=100.0).collect()[0].n == 20_000
    ranged, asked = counts._ranges(f, 100.0), counts._ranges(a, 100.0)
    rim = counts._rim_counts(ranged, asked, 100.0).collect()[0].n
    assert rim == sum(1 for i in range(20_000) if i % 200 < 10 or i // 200 < 5)


def test_no_areas(spark):
    f = spark.createDataFrame([("x", 0.0, 0.0, 1.0, 1.0)], f"layer string, {KEYS}")
    assert counts.counts_in_areas(f, spark.createDataFrame([], f"area_id long, {KEYS}")).collect() == []
