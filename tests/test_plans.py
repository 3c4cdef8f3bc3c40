"""Spatial joins are equi-joins on cells: no plan may fall back to comparing all pairs."""

import pytest
from compare import ROOT

from terrakit.registry import all_queries

QUERIES = all_queries()
BUILDS_FIRST = ("a1_", "a2_", "a4_", "a5_", "a14", "a15", "l1_", "l2_", "l3_")
ALL_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(BUILDS_FIRST)))
def test_no_nested_loops(spark, name):
    df = QUERIES[name](spark, f"{ROOT}/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(kind in plan for kind in ALL_PAIRS), plan


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from terrakit.functions.boxes import box_meets

    c = F.col
    boxes = spark.range(100).select(*[(c("id") * k).cast("double").alias(n) for k, n in enumerate(("min_e", "min_n", "max_e", "max_n"), 1)])
    import tempfile

    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/boxes"
    boxes.write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    df = spark.read.parquet(path).filter(box_meets(c("min_e"), c("min_n"), c("max_e"), c("max_n"), 1.0, 2.0, 30.0, 40.0))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(min_e,30.0)" in plan and "GreaterThanOrEqual(max_n,2.0)" in plan


def test_raster_plan_answers_for_every_area(spark):
    from terrakit.plans import raster

    areas = spark.createDataFrame(
        [(1, 2600000.0, 1200000.0, 2604000.0, 1203000.0), (2, 2600000.0, 1200000.0, 2600000.0, 1203000.0),
         (3, 2650000.0, 1200000.0, 2652000.0, 1202000.0), (4, None, None, None, None)],
        "area_id int, min_e double, min_n double, max_e double, max_n double")
    mask = spark.createDataFrame(
        [(1, 800.0, 2601000.0, 1201000.0, 2602000.0, 1202000.0), (3, 10.0, 2700000.0, 1100000.0, 2700001.0, 1100000.0)],
        "mask_id int, radius double, ax double, ay double, bx double, by double")
    tiles, status = raster.plan(areas, None, mask, max_tiles=6, edge=256, wanted_m_per_px=2.0)
    rows = {r.area_id: r for r in status.collect()}
    assert {k: r.reason for k, r in rows.items()} == {1: None, 2: "no_extent", 3: "no_tile_in_mask", 4: "no_extent"}
    assert rows[1].tiles == tiles.filter("area_id = 1").count() <= 6 and rows[1].m_per_px > 2.0
    none = raster.plan(areas.limit(0), None, mask, max_tiles=6, edge=256, wanted_m_per_px=2.0)
    assert [x.count() for x in none] == [0, 0]
