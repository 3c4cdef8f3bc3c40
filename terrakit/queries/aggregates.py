"""Counts, newest-per-key, profiles, pixel statistics, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrakit.functions import attrs
from terrakit.operators import cells, newest, pixels, stages
from terrakit.plans import counts, layers, profile, units
from terrakit.queries.attributes import FOLD_SQL
from terrakit.registry import query

c = F.col


def n(alias="n"):
    return F.count(F.lit(1)).alias(alias)


@query("e1_rows_per_layer", "E1", uses="b_features", sql="select layer, count(*) n from b_features group by layer")
def _(t):
    return t.b_features.groupBy("layer").agg(n())


@query("e2_boxes_in_box", "E2", uses="b_segments", sql="""
    select count(*) n from b_segments where greatest(ax,bx)>=2600000 and least(ax,bx)<=2700000
      and greatest(ay,b_y)>=1150000 and least(ay,b_y)<=1230000""")
def _(t):
    from terrakit.functions.boxes import box_meets
    s = t.b_segments
    meets = box_meets(F.least("ax", "bx"), F.least("ay", "b_y"), F.greatest("ax", "bx"), F.greatest("ay", "b_y"),
                      2600000.0, 1150000.0, 2700000.0, 1230000.0)
    return s.agg(F.count_if(meets).alias("n"))


LAYER_NAMES = ["tlm_strassen_strasse", "tlm_bb_bodenbedeckung", "ski_network", "VeloWeg", "tlm_namen_flurname"]
PRESET_NAMES = ["hiking", "cycling", "skimo", "full"]


def feature_boxes(t):
    name = F.element_at(F.array(*[F.lit(x) for x in LAYER_NAMES]), (c("id") % 5 + 1).cast("int"))
    reach = (c("id") % 9 * 400).cast("double")
    return t.b_points.select(name.alias("layer"), (c("e") - reach).alias("min_e"), (c("n") - reach).alias("min_n"),
                             (c("e") + reach).alias("max_e"), (c("n") + reach).alias("max_n"))


def request_areas(t):
    preset = F.element_at(F.array(*[F.lit(x) for x in PRESET_NAMES]), (c("sid") % 4 + 1).cast("int"))
    off = F.when(c("sid") % 3 == 0, F.array(F.lit("tlm_bb_bodenbedeckung"))).otherwise(F.array().cast("array<string>"))
    return t.b_segments.select(
        c("sid").alias("area_id"), preset.alias("preset"), off.alias("excluded"),
        (c("ax") - 12000).alias("min_e"), (c("ay") - 12000).alias("min_n"), (c("ax") + 12000).alias("max_e"), (c("ay") + 12000).alias("max_n"))


FEATURE_BOXES = f"""fb as (select case id%5 {' '.join(f"when {i} then '{x}'" for i, x in enumerate(LAYER_NAMES))} end layer,
      e-id%9*400 e0, n-id%9*400 n0, e+id%9*400 e1, n+id%9*400 n1 from b_points)"""


@query("e3_group_counts_per_area", "E3", uses="b_points b_segments", sql=f"""
    with {FEATURE_BOXES},
    ar as (select sid, case sid%4 when 0 then 'hiking' when 1 then 'cycling' when 2 then 'skimo' else 'full' end preset, ax, ay from b_segments),
    g(layer, grp) as (values ('tlm_strassen_strasse','transport'),('tlm_bb_bodenbedeckung','landCover'),('ski_network','winter'),
      ('VeloWeg','cycling'),('tlm_namen_flurname','names')),
    cnt as (select sid, grp, count(*) n from ar join fb on e1>=ax-12000 and e0<=ax+12000 and n1>=ay-12000 and n0<=ay+12000
      join g on g.layer=fb.layer where not (sid%3=0 and fb.layer='tlm_bb_bodenbedeckung') group by 1,2),
    keys as (select sid, grp from ar cross join (values ('landCover'),('water'),('transport'),('built'),('names'),('winter'),('cycling')) v(grp)
      where not (grp='winter' and preset in ('hiking','cycling')) and not (grp='cycling' and preset in ('hiking','skimo')))
    select keys.sid area_id, keys.grp, coalesce(n,0) n from keys left join cnt on cnt.sid=keys.sid and cnt.grp=keys.grp""")
def _(t):
    found = counts.counts_in_areas(feature_boxes(t), request_areas(t))
    return counts.group_counts(found, request_areas(t), layers.layer_specs(t.spark), layers.PRESETS)


@query("e4_extraction_report", "E4", uses="b_features", sql="""
    with f as (select case layer when 'roads' then 'transport' else 'cover' end grp, layer, width before, floor(width/3) after from b_features)
    select grp, layer, cast(grouping(grp)+grouping(layer) as int) depth, count(*) features, sum(before) points_before, cast(sum(after) as bigint) points_after,
      round(case when sum(before)=0 then 0 else 1-sum(after)/sum(before) end,6) ratio from f group by rollup(grp, layer)""")
def _(t):
    f = t.b_features.select(F.when(c("layer") == "roads", "transport").otherwise("cover").alias("grp"), "layer",
                            c("width").alias("before"), F.floor(c("width") / 3).alias("after"))
    total = F.sum("before")
    ratio = F.when(total == 0, 0.0).otherwise(1.0 - F.sum("after") / F.when(total == 0, 1.0).otherwise(total))
    return f.rollup("grp", "layer").agg(
        (F.grouping("grp").cast("int") + F.grouping("layer").cast("int")).alias("depth"), n("features"),
        total.alias("points_before"), F.sum("after").alias("points_after"), F.round(ratio, 6).alias("ratio"))


@query("e5_newest_tiles", "E5 F1", uses="b_assets", sql="""
    select cell, yr, item from (select *, row_number() over (partition by cell order by yr desc, item) k from b_assets) q where k=1""")
def _(t):
    return newest.newest(t.b_assets, ["cell"], [c("yr"), -c("item")], ["yr", "item"])


@query("e5_newest_tile_per_km", "E5 D12", uses="b_assets", sql="""
    select e_km, n_km, yr, item from (select *, row_number() over (partition by e_km, n_km order by yr desc, item) k from
      (select cast(substr(name,18,4) as int) e_km, cast(substr(name,23,4) as int) n_km, yr, item from b_assets) a) q where k=1""")
def _(t):
    name = c("name")
    a = t.b_assets.filter(name.endswith(attrs.TILE_SUFFIX)).select(
        attrs.tile_e_km(name).alias("e_km"), attrs.tile_n_km(name).alias("n_km"), "yr", "item", "name")
    return newest.newest_tiles(a).select("e_km", "n_km", "yr", "item")


@query("e5_latest_releases", "E5 K9", sql="""
    select o_custkey collection, o_orderkey item, o_orderstatus from
      (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) k from orders) q where k=1""")
def _(t):
    o = t.orders.select(c("o_custkey").alias("collection"), c("o_orderkey").alias("item"), "o_orderstatus", "o_orderdate")
    return newest.newest(o, ["collection"], [c("o_orderdate"), c("item")], ["item", "o_orderstatus"])


@query("e6_sources_per_release", "E6", uses="b_assets", sql="""
    select yr, cell%50 item, count(*) files, cast(sum(item) as bigint) bytes, min(name) first_name from
      (select yr, cell, b.item, first_value(name) over (partition by yr, cell%50 order by b.item) name from b_assets b where b.item%7<>0) q
    group by 1,2""")
def _(t):
    from terrakit.sources.manifest import sources_by_release
    entries = t.b_assets.select(
        F.when(c("item") % 7 != 0, c("yr")).alias("collection"), (c("cell") % 50).alias("item"), c("item").alias("bytes"),
        c("name"), c("item").alias("pos"))
    return sources_by_release(entries).select(
        c("collection").alias("yr"), "item", "files", "bytes", c("first").alias("first_name"))


@query("e7_merged_units", "E7", sql="""
    with u as (select n_nationkey number, n_name || case when c_custkey%2=0 then '' else ' See' end name, c_custkey, c_acctbal from customer join nation on n_nationkey=c_nationkey)
    select number, name, round(sum(abs(c_acctbal)),2) area_km2, min(c_custkey) population from u group by 1,2""")
def _(t):
    u = t.customer.join(t.nation, c("n_nationkey") == c("c_nationkey")).select(
        c("n_nationkey").alias("number"),
        F.concat("n_name", F.when(c("c_custkey") % 2 == 0, "").otherwise(" See")).alias("name"),
        F.abs("c_acctbal").alias("area_km2"), c("c_custkey").alias("population"), c("c_custkey").alias("row_id"), F.lit("").alias("canton"))
    return units.merged(u).select("number", "name", F.round("area_km2", 2).alias("area_km2"), "population")


DIRS = ["ch.swisstopo.swissalti3d", "builds", "recipes", ".quarantine", "winter", "ch.astra.veloland", ".tmp", ""]


@query("e8_storage_use", "E8", sql="""
    select case doc_id%8 when 0 then 'elevation' when 1 then 'builds' when 2 then 'recipes' when 3 then 'quarantine'
      when 4 then 'datasets' when 5 then 'datasets' else 'other' end category, cast(sum(n_chars) as bigint) bytes from documents group by 1""")
def _(t):
    from terrakit.sources.manifest import storage_use
    folder = F.element_at(F.array(*[F.lit(x) for x in DIRS]), (c("doc_id") % 8 + 1).cast("int"))
    path = F.concat(folder, F.when(folder == "", "").otherwise("/"), c("doc_id").cast("string"), F.lit(".bin"))
    return storage_use(t.documents.select(path.alias("path"), c("n_chars").alias("bytes")))


@query("e12_duplicates_skipped", "E12", uses="b_assets",
       sql="select count(*) matching, count(distinct cell) kept, count(*)-count(distinct cell) duplicates from b_assets")
def _(t):
    # Counted through the kept cells, so no task sees more than partial counts.
    per = t.b_assets.groupBy("cell").agg(n("k"))
    return per.agg(F.sum("k").alias("matching"), n("kept"), (F.sum("k") - F.count(F.lit(1))).alias("duplicates"))


@query("e13_extents", "E13", uses="b_polys", sql="""
    select poly%5 grp, min(e)-1500 min_e, min(n)-1500 min_n, max(e)+1500 max_e, max(n)+1500 max_n from b_polys group by 1""")
def _(t):
    boxes = t.b_polys.select((c("poly") % 5).alias("grp"), c("e").alias("min_e"), c("n").alias("min_n"), c("e").alias("max_e"), c("n").alias("max_n"))
    return units.extent(boxes, 1500.0, ["grp"])


PROFILED = ["layer", "objektart", "name", "access"]


@query("e14_column_profile", "E14 G4", uses="b_features", sql="""
    with u as (select 'layer' col, layer val from b_features union all select 'objektart', nullif(objektart,'k_W') from b_features
      union all select 'name', name from b_features union all select 'access', cast(access as varchar) from b_features),
    v as (select col, val, count(*) n from u where val is not null group by 1,2),
    k as (select col, count(*) d from v group by 1),
    top as (select * from (select *, row_number() over (partition by col order by n desc, val) r from v) q where r=1)
    select u.col, count(*)-count(val) nulls, case when max(d)>300 then '>300' else cast(max(d) as varchar) end cardinality,
      case when max(d)<=300 then max(t.tv) end top, case when max(d)<=300 then max(t.tn) end top_n
    from u join k on k.col=u.col join (select col, val tv, n tn from top) t on t.col=u.col group by u.col""")
def _(t):
    f = t.b_features.withColumn("objektart", F.when(c("objektart") != "k_W", c("objektart")))
    return profile.profile(f, PROFILED)


@query("e15_duplicate_names", "E15", sql="select p_name name, count(*) n from part group by 1 having count(*)>1")
def _(t):
    return profile.duplicates(t.part.select(c("p_name").alias("name")), "name")


VALUES = """v as (select 'p_brand' col, p_brand val, count(*) n from part group by 2 union all select 'p_type', p_type, count(*) from part group by 2
      union all select 'p_name', p_name, count(*) from part group by 2),
    r as (select *, row_number() over (partition by col order by n desc, val) rank from v)"""


@query("e16_value_domains", "E16", sql=f"""
    with {VALUES} select col, val, n, rank, (select count(*) from v w where w.col=r.col)>10 overflow from r where rank<=10""")
def _(t):
    return profile.domain(profile.value_counts(t.part, ["p_brand", "p_type", "p_name"]), 10)


@query("e17_distinct_counts", "E17", sql="""
    select 'p_brand' col, count(distinct p_brand) "distinct" from part union all select 'p_type', count(distinct p_type) from part
    union all select 'p_size', count(distinct p_size) from part""")
def _(t):
    return profile.distinct_counts(t.part, ["p_brand", "p_type", "p_size"])


@query("g4_most_common", "G4", sql=f"with {VALUES} select col, val, n, rank from r where rank<=40")
def _(t):
    return profile.most_common(profile.value_counts(t.part, ["p_brand", "p_type", "p_name"]), 40)


NEAREST = """with e as (select sid, ax, ay, bx, b_y from b_segments),
    d as (select sid, min(sqrt((p.e-ax)*(p.e-ax)+(p.n-ay)*(p.n-ay))) first_, min(sqrt((p.e-bx)*(p.e-bx)+(p.n-b_y)*(p.n-b_y))) last_
      from e cross join b_points p group by sid),
    v as (select sid, case when abs(first_-last_)<20 then 'ambiguous' when (sid%2=0 and first_<last_) or (sid%2=1 and last_<first_)
      then 'agree' else 'disagree' end verdict from d)"""


@query("e23_direction_agreement", "E23 D13", uses="b_segments b_points",
       sql=NEAREST + " select verdict, count(*) n from v group by 1")
def _(t):
    from terrakit.operators.direction import verdicts
    s = t.b_segments.withColumnRenamed("b_y", "by").withColumn("kind", F.when(c("sid") % 2 == 0, "Ausfahrt").otherwise("Einfahrt"))
    return verdicts(s, t.b_points, 20.0).groupBy("verdict").agg(n())


@query("e24_dominant_colours", "E24 F10", uses="b_pixels", sql="""
    with k as (select spot, cr, cg, cb, count(*) n from b_pixels where not (greatest(cr,cg,cb)>246 and least(cr,cg,cb)>240)
      and greatest(cr,cg,cb)>=60 and not (abs(cr-cg)<4 and abs(cg-cb)<4 and abs(cr-cb)<4) group by 1,2,3,4),
    r as (select *, row_number() over (partition by spot order by n desc, cr, cg, cb) rank, sum(n) over (partition by spot) total from k)
    select spot, rank, printf('#%02X%02X%02X', cr, cg, cb) colour, round(100e0*n/total,1) percent from r where rank<=3""")
def _(t):
    return pixels.dominant_colours(t.b_pixels)


@query("e25_seasonal_shift", "E25", uses="b_pixels", sql="""
    with f as (select * from b_pixels where not (greatest(cr,cg,cb)>235 and least(cr,cg,cb)>228) and greatest(cr,cg,cb)>=90
        and not (abs(cr-cg)<5 and abs(cg-cb)<5 and abs(cr-cb)<5)),
    w as (select spot, least(cr+12,255) cr, greatest(cg-7,0) cg, cb from b_pixels),
    g as (select * from w where not (greatest(cr,cg,cb)>235 and least(cr,cg,cb)>228) and greatest(cr,cg,cb)>=90
        and not (abs(cr-cg)<5 and abs(cg-cb)<5 and abs(cr-cb)<5)),
    a as (select spot, round_even(median(cr),0) r, round_even(median(cg),0) gg, round_even(median(cb),0) b from f group by 1 having count(*)>=200),
    z as (select spot, round_even(median(cr),0) r, round_even(median(cg),0) gg, round_even(median(cb),0) b from g group by 1 having count(*)>=200)
    select a.spot%4 fill, cast(round_even(median(z.r)-median(a.r),0) as int) dr, cast(round_even(median(z.gg)-median(a.gg),0) as int) dg,
      cast(round_even(median(z.b)-median(a.b),0) as int) db from a join z on a.spot=z.spot group by 1""")
def _(t):
    p = t.b_pixels
    snow = p.select("spot", F.least(c("cr") + 12, F.lit(255)).alias("cr"), F.greatest(c("cg") - 7, F.lit(0)).alias("cg"), "cb")
    summer = pixels.fill_medians(p, least=200).withColumn("fill", c("spot") % 4)
    return pixels.seasonal_shift(summer, pixels.fill_medians(snow, least=200), "fill")


@query("e26_picture_difference", "E26", uses="b_pixels", sql="""
    with a as (select spot, px, min(cr) cr, min(cg) cg, min(cb) cb from b_pixels group by 1,2)
    select spot, case when spot%10=0 then 100 else round(100e0*count(*) filter (px%500<spot%3)/count(*),6) end percent,
      case when spot%10=0 or 100e0*count(*) filter (px%500<spot%3)/count(*)>0.2 then 'differs' else 'ok' end verdict,
      spot%2=1 release_changed from a group by spot""")
def _(t):
    base = t.b_pixels.groupBy("spot", "px").agg(F.min("cr").alias("cr"), F.min("cg").alias("cg"), F.min("cb").alias("cb"))
    golden = base.withColumn("release", F.lit("r1"))
    moved = c("px") % 500 < c("spot") % 3
    grown = F.when(c("spot") % 10 == 0, c("px") + 1000000000).otherwise(c("px"))
    current = base.select("spot", grown.alias("px"), F.when(moved, c("cr") + 1).otherwise(c("cr")).alias("cr"), "cg", "cb",
                          F.when(c("spot") % 2 == 1, "r2").otherwise("r1").alias("release"))
    return pixels.difference(golden, current).withColumn("percent", F.round("percent", 6))


@query("e27_counts_per_km_cell", "E27", uses="b_points", sql=f"""
    with {FEATURE_BOXES}, b as (select layer, cast(floor(e0/1000) as int) a, greatest(cast(ceil(e1/1000) as int)-1, cast(floor(e0/1000) as int)) b,
      cast(floor(n0/1000) as int) c, greatest(cast(ceil(n1/1000) as int)-1, cast(floor(n0/1000) as int)) d from fb),
    x as (select layer, unnest(generate_series(a,b)) e_km, c, d from b), y as (select layer, e_km, unnest(generate_series(c,d)) n_km from x)
    select e_km, n_km, layer, count(*) n from y group by 1,2,3""")
def _(t):
    return cells.cell_counts(feature_boxes(t))


SPANS = """with u as (select run, stage, ts, event_id, lag(stage) over (partition by run order by ts, event_id) p from b_updates),
    ch as (select *, lead(ts) over (partition by run order by ts, event_id) nxt, row_number() over (partition by run order by ts, event_id) k
      from u where p is null or p<>stage),
    sp as (select ch.run, k, stage, (epoch_us(coalesce(nxt, m))-epoch_us(ts))/1e6 as seconds from ch
      join (select run, max(ts) m from b_updates group by 1) e on e.run=ch.run)"""


def spans(t):
    return stages.stage_spans(t.b_updates, F.to_date("ts"), ["ts", "event_id"], F.date_trunc("second", "ts"))


@query("f3_stage_spans", "F3 L1", uses="b_updates", sql=SPANS + " select run, k, stage, round(seconds,6) as seconds from sp")
def _(t):
    return spans(t).select("run", "k", "stage", F.round("seconds", 6).alias("seconds"))


STAGE_OF = {"view": "extract", "click": "elevation", "error": "unknown", "purchase": "contours", "signup": "compile"}


@query("e22_stage_weights", "E22 F10", uses="b_updates", sql=SPANS + """
    , d as (select run, case stage when 'view' then 'extract' when 'click' then 'elevation' when 'purchase' then 'contours'
      when 'signup' then 'compile' else 'unknown' end stage, sum(seconds) s from sp group by 1,2),
    f as (select run, stage, s/sum(s) over (partition by run) f, sum(s) over (partition by run) total from d),
    w as (select stage, sum(f) s from f where total>0 and stage<>'unknown' group by 1)
    select v.stage, round(coalesce(s,0)/(select sum(s) from w),6) weight from
      (values ('extract'),('elevation'),('contours'),('relief'),('split'),('compile'),('verify')) v(stage) left join w on w.stage=v.stage""")
def _(t):
    from terrakit.plans.estimate import stage_weights
    name = c("stage")
    for kind, stage in STAGE_OF.items():
        name = F.when(c("stage") == kind, stage).otherwise(name)
    return stage_weights(stages.stage_durations(spans(t).withColumn("stage", name))).withColumn("weight", F.round("weight", 6))


@query("f9_part_numbers", "F9", sql="""
    select s_nationkey grp, s_suppkey id, row_number() over (partition by s_nationkey order by s_suppkey) || ' of ' || count(*) over (partition by s_nationkey) part from supplier""")
def _(t):
    from terrakit.operators.ordered import CHUNK, ranked
    s = t.supplier.select(c("s_nationkey").alias("grp"), c("s_suppkey").alias("id"))
    numbered = ranked(s, ["grp"], F.floor(c("id") / CHUNK), ["id"], "k")
    totals = s.groupBy("grp").agg(n("total"))
    return numbered.join(totals, "grp").select("grp", "id", F.concat(c("k").cast("string"), F.lit(" of "), c("total").cast("string")).alias("part"))


PLACES = f"""pl as (select p_partkey id, p_name || ' | ' || p_type || ' ' || p_name raw, p_size%10-1 pop from part),
    q as (select distinct substr({FOLD_SQL % 'p_name'},1,4) want from part union select distinct {FOLD_SQL % 'p_name'} from part),
    va as (select id, pop, {FOLD_SQL % "unnest(string_split(raw,'|'))"} f, generate_subscripts(string_split(raw,'|'),1) pos from pl),
    hit as (select want, id, pop, arg_min(f,pos) f from va join q on starts_with(f, want) group by 1,2,3),
    r as (select want, id, row_number() over (partition by want order by pop+case when f=want then 1 else 0 end desc, case when f=want then 0 else 1 end, length(f), id) rank from hit)"""


@query("g1_place_search", "G1 F7", sql=f"with {PLACES} select want, id, rank from r where rank<=50")
def _(t):
    from terrakit.operators.places import search, with_variants
    raw = F.concat("p_name", F.lit(" | "), "p_type", F.lit(" "), "p_name")
    places = t.part.select(c("p_partkey").alias("id"), raw.alias("name"), (c("p_size") % 10 - 1).alias("population_rank"))
    folded = attrs.fold(c("p_name"))
    wants = t.part.select(F.explode(F.array(F.substring(folded, 1, 4), folded)).alias("want")).distinct()
    return search(with_variants(places), wants).select("want", "id", "rank")


@query("g2_missing_cell_text", "G2", uses="b_points", sql="""
    with w as (select distinct cast(floor(e/1000) as int) a, cast(floor(n/1000) as int) b from b_points),
    r as (select *, row_number() over (order by a, b) k, count(*) over () total from w)
    select max(total) || ' km cells without elevation: ' || string_agg(a || '-' || b, ', ' order by k) filter (k<=12)
      || case when max(total)>12 then ' and ' || (max(total)-12) || ' more' else '' end warning from r""")
def _(t):
    from terrakit.operators.places import missing_tile_warning
    cells_ = t.b_points.select(F.floor(c("e") / 1000).cast("int").alias("e_km"), F.floor(c("n") / 1000).cast("int").alias("n_km")).distinct()
    return missing_tile_warning(cells_)


@query("g3_unit_listing", "G3", sql="select n_name name, n_nationkey number from nation order by 1,2")
def _(t):
    return units.listed(t.nation.select(c("n_name").alias("name"), c("n_nationkey").alias("number")))


@query("g5_first_features", "G5", uses="b_features", sql="""
    select layer, id from (select layer, id, row_number() over (partition by layer order by id) k from (select distinct layer, id from b_features) d) q where k<=100""")
def _(t):
    # A consumer that stops after 100 per layer; the engine keeps 100 per task before it shuffles.
    from pyspark.sql.window import Window
    d = t.b_features.select("layer", "id").distinct()
    w = Window.partitionBy("layer").orderBy("id")
    return d.withColumn("k", F.row_number().over(w)).filter("k <= 100").drop("k")


@query("h1_source_union", "H1 A16", uses="b_features", sql="""
    select 'base' source, count(*) n, count(objektart) with_kind from b_features where layer<>'names'
    union all select 'huts', count(*), 0 from b_features where layer='names' union all select 'cycle', count(*), count(objektart) from b_features where access=1""")
def _(t):
    from terrakit.plans.region import assemble
    f = t.b_features
    made, _ = assemble({"base": f.filter("layer <> 'names'"), "huts": f.filter("layer = 'names'").select("id", "layer", "name"),
                        "winter": None, "cycle": f.filter("access = 1")}, winter=True, cycle=True)
    return made.groupBy("source").agg(n(), F.count("objektart").alias("with_kind"))


@query("h5_layers_of_presets", "H5 G3", uses="b_features", sql="""
    with f as (select case layer when 'roads' then case access when 2 then 'ski_network' when 1 then 'VeloWeg' else 'tlm_strassen_strasse' end
      when 'cover' then 'tlm_bb_bodenbedeckung' else 'tlm_namen_flurname' end layer from b_features)
    select layer, case layer when 'VeloWeg' then 'cycling' when 'tlm_strassen_strasse' then 'transport'
      when 'tlm_bb_bodenbedeckung' then 'landCover' else 'names' end grp, count(*) n from f where layer<>'ski_network' group by 1,2""")
def _(t):
    road = F.when(c("access") == 2, "ski_network").when(c("access") == 1, "VeloWeg").otherwise("tlm_strassen_strasse")
    layer = F.when(c("layer") == "roads", road).when(c("layer") == "cover", "tlm_bb_bodenbedeckung").otherwise("tlm_namen_flurname")
    seen = t.b_features.groupBy(layer.alias("layer")).agg(n())
    # The winter network is no layer of these presets.
    return layers.needed_layers(t.spark, ["hiking", "cycling"]).select("layer", "grp").join(seen, "layer")

