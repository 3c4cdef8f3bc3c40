"""Rules, estimates, partition and raster plans, places, profiles, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakit.operators import places
from terrakit.plans import estimate, layers, partition, profile, raster, region, rules
from terrakit.streaming import stage_clock

c = F.col


def classified(spark, rows, kind="lines", rule_list=None):
    df = spark.createDataFrame(rows, "id int, tags map<string,string>")
    return {(r.id, r.type) for r in rules.classify(df, rule_list or rules.rule_set(kind), rules.map_tag()).collect()}


def test_rule_order_and_continue(spark):
    rows = [
        (1, {"tlm:objektart": "2m Weg", "tlm:wanderwege": "Wanderweg"}), (2, {"tlm:objektart": "Autobahn"}),
        (3, {"tlm:layer": "tlm_gewaesser_fliessgewaesser", "tlm:name": "Aare"}), (4, {"tlm:layer": "tlm_gewaesser_fliessgewaesser"}),
        (5, {"contour": "elevation", "contour_surface": "ice", "contour_ext": "elevation_major"}), (6, {"x": "y"}),
        (7, {"sac:layer": "ski_network_2056", "sac:discipline": "ski_tour", "sac:access": "2"})]
    assert classified(spark, rows) == {
        (1, "0x10101"), (1, "0x0a"), (2, "0x01"), (3, "0x1f"), (4, "0x18"), (5, "0x23"), (7, "0x10109")}


def test_rule_tables_have_all_rules():
    assert [len(rules.rule_set(k)) for k in ("lines", "points", "polygons")] == [52, 11, 27]
    small = rules.reduced(rules.rule_set("polygons"), "polygons")
    assert not {r.type for r in small} & set(rules.DROP_TYPES)
    contour = [r for r in rules.reduced(rules.rule_set("lines"), "lines") if r.type == "0x20"][0]
    assert contour.resolution == 24
    assert len(rules.reduced(rules.rule_set("points"), "points")) == 9


def test_rules_from_a_user_table(spark):
    rows = [(1, "kind=b", "B", 20, None, None, False), (0, "kind=a", "A", 20, 1, 2, True)]
    table = spark.createDataFrame(rows, "number int, condition string, type string, resolution int, road_class int, road_speed int, more boolean")
    own = rules.rules_from_table(table)
    assert classified(spark, [(1, {"kind": "a"}), (2, {"kind": "b"})], rule_list=own) == {(1, "A"), (2, "B")}


def test_access(spark):
    rows = [
        (1, {"tlm:verkehrsbeschraenkung": "Militaerstrasse"}), (2, {"tlm:befahrbarkeit": "Falsch", "motor_vehicle": "destination"}),
        (3, {"tlm:kunstbaute": "Steg mit Treppe", "tlm:stufe": "2"}), (4, {"tlm:richtungsgetrennt": "Wahr", "tlm:verkehrsbeschraenkung": "Gesperrt"})]
    df = spark.createDataFrame(rows, "id int, tags map<string,string>")
    got = {r.id: r.tags for r in rules.derive_access(df).collect()}
    assert got[1]["mkgmap:foot"] == "yes" and got[1]["mkgmap:car"] == "no"
    assert got[2]["motor_vehicle"] == "destination" and "mkgmap:car" not in got[2]
    assert got[3]["layer"] == "2" and got[3]["mkgmap:bicycle"] == "no" and got[3]["foot"] == "yes"
    assert got[4]["mkgmap:dead-end-check"] == "false" and got[4]["tlm:richtungsgetrennt"] == "Wahr"


def test_layer_tables(spark):
    specs = layers.layer_specs(spark)
    assert specs.count() == 22 and specs.filter("needs = 'base' and prefix = 'tlm'").count() == 14
    assert layers.needed_layers(spark, ["hiking"]).count() == 15 and layers.needed_layers(spark, ["hiking", "full"]).count() == 22
    with pytest.raises(ValueError):
        region.assemble({"base": None}, False, False)
    base = spark.range(2)
    made, warnings = region.assemble({"base": base}, winter=True, cycle=False)
    assert made.count() == 2 and len(warnings) == 2


def make_samples(spark, size=40):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(size):
        t, b, w, area = (float(v) for v in rng.integers(100, 5000, 4))
        rows.append((k, int(t), int(b), int(w), area / 10, 10 if k % 3 else 20, "detailed" if k % 2 else "gentle", False, k % 3 == 0, False, k % 5 == 0))
    df = estimate.with_defaults(spark.createDataFrame(
        rows, "id int, transport long, built long, water long, area_km2 double, contour_interval_m int, relief string, "
        "slope_classes boolean, routing boolean, addresses boolean, wrist boolean"))
    truth = [30000.0, 0, 15.0, 22.0, 7.0, 0, 0, 0, 1500.0, 900.0, 120.0]
    return df.withColumn("actual_bytes", estimate.predict(truth)), truth


def test_fit_recovers_a_model(spark):
    df, truth = make_samples(spark)
    model, n = estimate.fit(df, lam=1e-3)
    assert n == 40
    assert estimate.mape(df, model).first()["mape"] < 1e-3
    assert model[3] == pytest.approx(truth[3], rel=0.01)
    # Terms without data keep the prior; no samples keep all of it.
    assert model[5] == pytest.approx(estimate.PRIOR[5], rel=1e-6)
    assert estimate.fit(df.limit(0))[0] == estimate.PRIOR
    assert estimate.fit(df, lam=0.0)[0] == estimate.PRIOR
    strong, _ = estimate.fit(df, lam=1e20)
    assert strong == pytest.approx(estimate.PRIOR, rel=1e-3)


def test_left_out_errors_match_refits(spark):
    df, _ = make_samples(spark, 6)
    df = df.withColumn("actual_bytes", (c("actual_bytes") * (1 + c("id") / 20)).cast("bigint"))
    got = {r["lambda"]: r["mape"] for r in estimate.loocv(df, lambdas=[1e3, 1e8]).collect()}
    for lam, value in got.items():
        errors = []
        for k in range(6):
            model, _ = estimate.fit(df.filter(c("id") != k), lam=lam)
            errors.append(estimate.mape(df.filter(c("id") == k), model).first()["mape"])
        assert value == pytest.approx(sum(errors) / 6, rel=1e-4)
    two = estimate.loocv(df.limit(2), lambdas=[1e3]).first()
    assert two["mape"] == float("inf")


def test_stage_weights(spark):
    runs = spark.createDataFrame([(1, "extract", 1.0), (1, "contours", 3.0), (2, "extract", 50.0), (2, "other", 50.0)], "run int, stage string, seconds double")
    got = {r.stage: r.weight for r in estimate.stage_weights(runs).collect()}
    assert got["extract"] == pytest.approx(0.375 / 0.75) and got["verify"] == 0
    shipped = {r.stage: r.weight for r in estimate.stage_weights(runs.limit(0)).collect()}
    assert shipped["contours"] == 0.4336


def test_partition_plan_is_honest(spark):
    df = estimate.with_defaults(spark.createDataFrame(
        [(1, 10_000, 100.0, 10_000_000), (2, 10_000, 100.0, 100_000), (3, 10, 1.0, 40_000)],
        "area_id int, transport long, area_km2 double, budget long")).withColumn("contour_interval_m", F.lit(20))
    got = {r.area_id: r for r in partition.plan(df).collect()}
    assert got[1].side == 1 and got[1].fits
    assert got[2].side > 1 and got[2].fits and got[2].part_bytes <= 100_000
    assert got[3].side == 32 and not got[3].fits
    text = partition.plan(df).select(partition.reason(c("whole"), c("budget"), c("fits"), c("side"), 50).alias("t"), "area_id").collect()
    assert {r.area_id: r.t.split()[0] for r in text} == {1: "split", 2: "split", 3: "too_large"}


def test_raster_plan(spark):
    boxes = spark.createDataFrame(
        [(1, 2600000.0, 1200000.0, 2604000.0, 1203000.0), (2, 2600000.0, 1200000.0, 2680000.0, 1260000.0)],
        "area_id int, min_e double, min_n double, max_e double, max_n double")
    got = raster.plan(boxes, None, None, 40, 1024, 1.0)[0].groupBy("area_id").agg(
        F.count("*").alias("m"), F.max("m_per_px").alias("r"), F.max("width").alias("w"), F.min("height").alias("h")).collect()
    by = {r.area_id: r for r in got}
    assert by[1].r == 1.25 and by[1].m == 12 and by[2].m <= 40 and by[2].r > 5
    assert all(r.w <= 1024 and r.h >= 1 for r in got)
    line = spark.createDataFrame([(2, 500.0, 2600000.0, 1200000.0, 2680000.0, 1260000.0)], "mask_id int, radius double, ax double, ay double, bx double, by double")
    masked = raster.plan(boxes.filter("area_id = 2"), None, line, 40, 1024, 1.0)[0].agg(F.max("m_per_px"), F.count("*")).first()
    # Only tiles along the line are paid for, so they are sharper.
    assert masked[0] < by[2].r and masked[1] <= 40
    with pytest.raises(ValueError):
        raster.plan(boxes, None, None, 0, 1024, 1.0)


def test_place_ranking(spark):
    rows = [(1, "Grindelwald", "2'000 bis 9'999"), (2, "Grindel", "100 bis 999"), (3, "Bern | Berna | Berne", "> 100'000"), (4, "Bernau", "< 20"),
            (5, "Genève | Genf", "> 100'000"), (6, "Bernex", None)]
    df = spark.createDataFrame(rows, "id int, name string, band string").withColumn("population_rank", places.population_rank(c("band")))
    wants = spark.createDataFrame([("grindel",), ("bern",), ("geneve",), ("genf",), ("berne",)], "want string")
    got = {}
    for r in places.search(places.with_variants(df), wants).orderBy("rank").collect():
        got.setdefault(r.want, []).append(r.id)
    assert got["grindel"] == [1, 2] and got["bern"] == [3, 4, 6] and got["geneve"] == [5] and got["genf"] == [5] and got["berne"] == [3, 6]


def test_profile_caps(spark):
    df = spark.range(2000).select((c("id") % 300).alias("a"), (c("id") % 301).alias("b"), c("id").alias("u"), F.lit(None).cast("string").alias("n"))
    got = {r.col: (r.nulls, r.cardinality) for r in profile.profile(df, ["a", "b", "u", "n"]).collect()}
    assert got == {"a": (0, "300"), "b": (0, ">300"), "u": (0, ">300"), "n": (2000, "0")}


def updates(spark, folder, batches):
    schema = "run long, stage string, ts timestamp, event_id long"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "run long, stage string, s double, event_id long").select(
            "run", "stage", F.timestamp_micros((c("s") * 1e6).cast("bigint")).alias("ts"), "event_id").coalesce(1).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def test_stage_clock_across_triggers(spark):
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    stream = updates(spark, folder, [
        [(1, "extract", 0.0, 1), (1, "extract", 1.0, 2)],
        [(1, "contours", 5.0, 3), (1, "contours", 7.0, 4), (2, "extract", 2.0, 5)],
        [(1, "finished", 9.0, 6), (1, "contours", 6.0, 7)]])
    out = stage_clock.replay(stream, stage_clock.stage_spans, folder)
    assert {(r.run, r.k, r.stage, r.seconds) for r in out.collect()} == {(1, 1, "extract", 5.0), (1, 2, "contours", 4.0)}


def test_stage_clock_takes_updates_in_any_order(spark):
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    stream = updates(spark, folder, [[(1, "a", 0.0, 1), (1, "d", 30.0, 4)], [(1, "b", 10.0, 2), (1, "c", 20.0, 3)]])
    out = stage_clock.replay(stream, stage_clock.stage_spans, folder)
    assert {(r.run, r.k, r.stage, r.seconds) for r in out.collect()} == {(1, 1, "a", 10.0), (1, 2, "b", 10.0), (1, 3, "c", 10.0)}


def test_throttle(spark):
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    stream = updates(spark, folder, [[(1, "a", 0.0, 1), (1, "a", 0.1, 2), (1, "a", 0.3, 3)], [(1, "a", 0.4, 4), (1, "b", 0.45, 5), (1, "b", 0.5, 6)]])
    out = stage_clock.replay(stream, stage_clock.throttled, folder)
    assert [(r.stage, r.changed) for r in out.orderBy("ts").collect()] == [("a", True), ("a", False), ("b", True)]


def test_streams_of_events_in_shuffled_part_files(spark):
    import tempfile

    import __spark_entry__

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(9, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    for name in ("l1_stage_clock", "l3_shown_updates"):
        query = __spark_entry__.queries()[name]
        one, many = (sorted(map(tuple, query(spark, p).collect()), key=repr) for p in ("/root/testdata/sf0.001", folder))
        assert one and many == one, name


def test_runs_that_share_a_state_stay_apart(spark):
    """Whole batches meet a few states, whatever the number of runs, with the same rows as a state each."""
    import tempfile

    rows = [(run, "abc"[(run or 0) * k % 3], k * 0.2 + (run or 0) * 0.01, k) for k in range(12) for run in (1, 2, 7, None, 5)]
    parts = [rows[1::2], rows[::2]]
    for operator in (stage_clock.stage_spans, stage_clock.throttled):
        got = []
        for buckets in (1, 100_000):
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            out = stage_clock.replay(updates(spark, folder, parts), lambda u: operator(u, buckets=buckets), folder)
            got.append(sorted(map(tuple, out.collect()), key=repr))
        assert got[0] == got[1] and {r[0] for r in got[0]} >= {1, 2, 7, 5}
