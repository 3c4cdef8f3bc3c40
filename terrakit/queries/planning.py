"""Size model, verdicts, partition and raster plans, release and output checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrakit.plans import coverage, devices, estimate, partition, raster
from terrakit.queries.aggregates import spans
from terrakit.queries.geometry import LAT, LON
from terrakit.queries.joins import SEG_D2, corridor_areas
from terrakit.registry import query

c = F.col


def samples(t):
    """Samples with interval, relief, flags and the wrist profile set from the id."""
    k = c("id")
    return estimate.with_defaults(t.b_samples.select(
        "id", c("transport").cast("bigint").alias("transport"), "built", "area_km2", "actual_bytes",
        F.when(k % 5 == 0, 0).otherwise(20).alias("contour_interval_m"),
        F.when(k % 3 == 0, "detailed").when(k % 3 == 1, "gentle").otherwise("off").alias("relief"),
        (k % 4 == 0).alias("slope_classes"), (k % 2 == 0).alias("routing"), (k % 7 == 0).alias("addresses"), (k % 6 == 0).alias("wrist")))


PREDICTED = """
    s as (select *, case when id%6=0 then 0.41e0 else 1e0 end f from b_samples),
    x as (select *, 48000e0 + transport*f*18 + built*f*9 + case when id%5=0 then 0 else area_km2*1900 end
      + case id%3 when 0 then area_km2*760 when 1 then area_km2*150 else 0 end
      + case when id%4=0 then area_km2*3568*(case when id%6=0 then 0.55e0 else 1e0 end) else 0 end
      + case when id%2=0 then transport*33.7e0 else 0 end + case when id%7=0 then built*0.59e0*10.5e0 else 0 end y from s),
    p as (select *, cast(floor(greatest(y,0)) as bigint) predicted from x)
"""


@query("k1_predicted_sizes", "K1", uses="b_samples", sql=f"with {PREDICTED} select id, predicted from p")
def _(t):
    return samples(t).select("id", estimate.predict().alias("predicted"))


PLAIN = """
    x as (select id, [1e0, 0e0, 0e0, transport*1e0, built*1e0, 0e0, 0e0, 0e0, area_km2, 0e0, 0e0] v, cast(actual_bytes as double) y from b_samples)
"""


def plain_samples(t):
    return estimate.with_defaults(t.b_samples.withColumn("contour_interval_m", F.lit(20)))


@query("e18_normal_equations", "E18", uses="b_samples", sql=f"""
    with {PLAIN}, ij as (select i, j from range(11) a(i) cross join range(11) b(j) where i<=j)
    select cast(i as int) i, cast(j as int) j, sum(v[i+1]*v[j+1]) v from x cross join ij group by i, j
    union all select cast(i as int), -1, sum(v[i+1]*y) from x cross join range(11) a(i) group by i""")
def _(t):
    return estimate.gram_rows(plain_samples(t))


@query("e19_prediction_error", "E19", uses="b_samples", sql=f"""
    with {PREDICTED} select round(avg(case when actual_bytes>0 then abs(predicted-actual_bytes)/cast(actual_bytes as double) else 0 end),6) mape, count(*) n from p""")
def _(t):
    return estimate.mape(samples(t)).withColumn("mape", F.round("mape", 6))


@query("e28_estimator_check", "E28", uses="b_samples", sql=f"""
    with {PREDICTED}, e as (select id%10 grp, id, abs(predicted-actual_bytes)/cast(actual_bytes as double) err from p)
    select grp, count(*) areas, round(avg(err),6) mean_error, round(max(err),6) worst, count(*) filter (err>0.25) over_limit from e group by 1""")
def _(t):
    # One row per group of areas: mean, worst and how many are off by more than a quarter.
    err = F.abs(c("predicted") - c("actual_bytes")) / c("actual_bytes").cast("double")
    rows = samples(t).withColumn("predicted", estimate.predict()).select((c("id") % 10).alias("grp"), err.alias("err"))
    return rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("areas"), F.round(F.avg("err"), 6).alias("mean_error"), F.round(F.max("err"), 6).alias("worst"),
        F.count_if(c("err") > 0.25).alias("over_limit"))


@query("e20_left_out_errors", "E20")
def _(t):
    return estimate.loocv(samples(t)).withColumn("mape", F.round("mape", 9))


@query("e21_chosen_lambda", "E21")
def _(t):
    return estimate.loocv(samples(t)).agg(
        F.min_by("lambda", F.struct("mape", "pos")).alias("lambda"), F.round(F.min("mape"), 9).alias("mape"))


@query("k2_fitted_model", "K2 K3")
def _(t):
    model = estimate.current_model(samples(t))
    return samples(t).select("id", estimate.predict(model).alias("predicted"))


@query("k4_budget_verdicts", "K4 G6", uses="b_samples", sql=f"""
    with {PREDICTED}, b as (select *, 200000+id%50*10000 budget, id%20 excluded from p)
    select id, predicted>budget over_budget, case when predicted>budget then predicted-budget else 0 end overshoot_bytes,
      case when predicted>budget then concat_ws(';', case when id%5<>0 then 'coarserContours' end, 'smallerArea',
        case when id%3<>2 then 'noRelief' end, case when id%4=0 then 'noSlopeClasses' end,
        case when excluded<14 then 'fewerLayers' end, 'splitIntoMapSets') else '' end remedies from b""")
def _(t):
    s = samples(t).withColumn("excluded", c("id") % 20).withColumn("budget", 200000 + c("id") % 50 * 10000)
    v = estimate.budget_verdict(estimate.predict(), c("budget"))
    return s.select("id", v.alias("v")).select(
        "id", "v.over_budget", "v.overshoot_bytes", F.array_join("v.remedies", ";").alias("remedies"))


def split_areas(t):
    s = estimate.with_defaults(t.b_samples.withColumn("contour_interval_m", F.lit(20)))
    return s.withColumn("area_id", c("id")).withColumn("budget", 60000 + c("id") % 50 * 1000).withColumn(
        "name", F.concat(F.lit("map "), c("id").cast("string"))).withColumns({
            "min_e": F.lit(2600000.0), "min_n": F.lit(1200000.0), "max_e": 2600000.0 + c("area_km2") * 100,
            "max_n": F.lit(1210000.0)})


SPLIT = """
    a as (select *, 60000+id%50*1000 budget, floor(48000+transport*18+built*9+area_km2*1900) whole from b_samples),
    s as (select a.*, side, floor(48000+floor(transport*(1e0/(side*side)))*18+floor(built*(1e0/(side*side)))*9+area_km2*(1e0/(side*side))*1900) part
      from a cross join range(1,33) r(side)),
    f as (select id, min(side) side from s where side>=least(greatest(cast(ceil(sqrt(ceil(whole/budget))) as bigint),1),32) and part<=budget group by id),
    pl as (select s.id, case when s.whole<=s.budget then 1 else s.side end side, case when s.whole<=s.budget then s.whole else s.part end part_bytes, s.budget, s.area_km2
      from s left join f on f.id=s.id where s.side = case when s.whole<=s.budget then 1 else coalesce(f.side,32) end)
"""


@query("k5_partition_plans", "K5", uses="b_samples", sql=f"""
    with {SPLIT} select id area_id, side, cast(part_bytes as bigint) part_bytes, part_bytes<=budget fits from pl""")
def _(t):
    return partition.plan(split_areas(t)).select("area_id", "side", "part_bytes", "fits")


@query("k5_partition_parts", "K5 F9", uses="b_samples", sql=f"""
    with {SPLIT}, r as (select *, unnest(generate_series(0, side-1)) rw from pl), q as (select *, unnest(generate_series(0, side-1)) cl from r)
    select id area_id, rw*side+cl+1 "index", side*side total,
      case when side=1 then 'map ' || id else 'map ' || id || ' ' || (rw*side+cl+1) || ' of ' || (side*side) end name,
      round(2600000e0+cl*(area_km2*100/side),3) min_e, round(1200000e0+(rw+1)*(10000e0/side),3) max_n from q""")
def _(t):
    return partition.parts(partition.plan(split_areas(t))).select(
        "area_id", "index", "total", "name", F.round("min_e", 3).alias("min_e"), F.round("max_n", 3).alias("max_n"))


@query("k6_raster_plans", "K6")
def _(t):
    extents, _, segs = corridor_areas(t, 1000.0)
    tiles, status = raster.plan(extents, None, segs, max_tiles=60, edge=1024, wanted_m_per_px=1.25)
    sums = tiles.groupBy("area_id").agg(F.sum(c("width") * c("height")).alias("pixels"))
    return status.join(sums, "area_id", "left").select(
        "area_id", "tiles", F.round("m_per_px", 6).alias("m_per_px"), "pixels", "reason")


@query("k6_unmasked_grid", "K6", uses="b_segments", sql=f"""
    with v as (select sid, e, n from b_segments cross join lateral (values (least(ax,bx)-1000, least(ay,b_y)-1000),
        (least(ax,bx)-1000, greatest(ay,b_y)+1000),(greatest(ax,bx)+1000, least(ay,b_y)-1000),(greatest(ax,bx)+1000, greatest(ay,b_y)+1000)) q(e,n)),
    d as (select sid, {LON} lon, {LAT} lat from v),
    x as (select sid, (max(lat)-min(lat))*111132e0 h, (max(lon)-min(lon))*cos(radians((max(lat)+min(lat))/2))*111132e0 w from d group by sid)
    select sid area_id, cast(ceil(greatest(ceil(w/5),1)/1024) as bigint) cols, cast(ceil(greatest(ceil(h/5),1)/1024) as bigint) "rows" from x
    """)
def _(t):
    extents, _, _ = corridor_areas(t, 1000.0)
    cols, rows = raster._shape(1024)
    return raster._ground(extents).withColumn("m_per_px", F.lit(5.0)).select("area_id", cols.alias("cols"), rows.alias("rows"))


@query("k7_disk_need", "K7 D11", uses="b_segments", sql=f"""
    with a as (select *, least(ax,bx)-3000 e0, least(ay,b_y)-3000 n0, greatest(ax,bx)+3000 e1, greatest(ay,b_y)+3000 n1 from b_segments),
    x as (select *, unnest(generate_series(cast(floor(e0/1000) as bigint), greatest(cast(ceil(e1/1000) as bigint)-1, cast(floor(e0/1000) as bigint)))) e_km from a),
    box as (select *, unnest(generate_series(cast(floor(n0/1000) as bigint), greatest(cast(ceil(n1/1000) as bigint)-1, cast(floor(n0/1000) as bigint)))) n_km from x),
    pr as (select box.*, (e_km+dx)*1000 e, (n_km+dy)*1000 n from box cross join (values (0,0),(1,0),(0,1),(1,1),(0.5e0,0.5e0)) v(dx,dy)),
    kept as (select distinct sid, e_km, n_km from pr where {SEG_D2} <= 9e6),
    grown as (select distinct sid, e_km+dx e_km, n_km+dy n_km from kept cross join
      (values (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) v(dx,dy)),
    cnt as (select g.sid, count(*) k from grown g join box b on g.sid=b.sid and g.e_km=b.e_km and g.n_km=b.n_km group by 1)
    select b_segments.sid area_id, case when b_segments.sid%4=0 then 536870912 else cast(coalesce(k,0)*1200000 as bigint)+536870912 end bytes
    from b_segments left join cnt on cnt.sid=b_segments.sid""")
def _(t):
    extents, rings, segs = corridor_areas(t, 3000.0)
    tiles = coverage.cells_needed(extents, rings, segs).groupBy("area_id").agg(F.count(F.lit(1)).alias("k"))
    joined = extents.join(tiles.hint("merge"), "area_id", "left")
    return joined.select("area_id", coverage.disk_need(F.coalesce("k", F.lit(0)), c("area_id") % 4 != 0).alias("bytes"))


@query("k8_progress", "K8 F3", uses="b_updates", sql="""
    with u as (select run, stage, ts, event_id, lag(stage) over (partition by run order by ts, event_id) p from b_updates),
    ch as (select *, row_number() over (partition by run order by ts, event_id) k from u where p is null or p<>stage),
    e as (select run, (epoch_us(ts)-min(epoch_us(ts)) over (partition by run))/1e6 elapsed, k from ch),
    f as (select *, case least(k,7) when 1 then 0.0372e0 when 2 then 0.3626e0 when 3 then 0.7962e0 when 4 then 0.803e0
       when 5 then 0.8588e0 when 6 then 0.9999e0 else 1.0e0 end fraction from e)
    select run, k, round(fraction,6) fraction, round(case when fraction<0.02 or elapsed<2 or fraction>=1 then null
      else elapsed*(1-fraction)/fraction end,3) eta from f""")
def _(t):
    sp = spans(t)
    began = sp.groupBy(c("run").alias("__run")).agg(F.min("since").alias("began"))
    elapsed = (F.unix_micros(c("since").cast("timestamp")) - F.unix_micros(c("began").cast("timestamp"))) / 1e6
    fraction = F.round(estimate.build_fraction(estimate.STAGE_SHARE, F.least(c("k"), F.lit(7)) - 1, F.lit(1.0)), 9)
    return sp.join(began, c("run") == c("__run")).select("run", "k", elapsed.alias("elapsed"), fraction.alias("fraction")).select(
        "run", "k", F.round("fraction", 6).alias("fraction"), F.round(estimate.eta_seconds(c("elapsed"), c("fraction")), 3).alias("eta"))


@query("k9_primary_assets", "K9", sql="""
    with a as (select o_custkey item, o_orderkey pos, 'data_' || o_orderkey || case o_orderkey%6 when 0 then '.gpkg' when 1 then '.shp.zip'
      when 2 then '.csv.zip' when 3 then '.gpkg.zip' else '.xml' end name from orders),
    r as (select *, case when name like '%.gpkg.zip' then 0 when name like '%.csv.zip' then 1 when name like '%.shp.zip' then 2
      when name like '%.gpkg' then 3 end pr from a),
    k as (select *, row_number() over (partition by item order by pr, pos) w from r where pr is not null)
    select item, name, case pr when 0 then 'zippedGeoPackage' when 1 then 'zippedCsv' when 2 then 'zippedShapefiles' else 'plainGeoPackage' end kind from k where w=1""")
def _(t):
    from terrakit.sources.catalogue import primary_assets
    end = F.element_at(F.array(*[F.lit(x) for x in (".gpkg", ".shp.zip", ".csv.zip", ".gpkg.zip", ".xml", ".xml")]), (c("o_orderkey") % 6 + 1).cast("int"))
    assets = t.orders.select(c("o_custkey").alias("item"), c("o_orderkey").alias("pos"), F.concat(F.lit("data_"), c("o_orderkey").cast("string"), end).alias("name"))
    return primary_assets(assets).select("item", "name", "kind")


@query("k10_output_checks", "K10", sql="""
    with o as (select o_orderkey id, cast(floor(o_totalprice*20000) as bigint) b, o_orderkey%200 t from orders)
    select id, case when b>3000000000 then 1 else 0 end + case when b>4294967295 then 1 else 0 end + case when t>150 then 1 else 0 end problems,
      case when b>3000000000 then 'bytes_over_device is=' || b || ' limit=3000000000' end first_problem from o""")
def _(t):
    o = t.orders.select(c("o_orderkey").alias("id"), F.floor(c("o_totalprice") * 20000).cast("bigint").alias("b"), (c("o_orderkey") % 200).alias("t"))
    found = devices.output_problems(c("b"), c("t"), F.lit(3000000000), F.lit(150))
    return o.select("id", found.alias("p"), "b").select(
        "id", F.size("p").alias("problems"), F.when(c("b") > 3000000000, F.try_element_at("p", F.lit(1))).alias("first_problem"))
