"""Elevation, contours, slope and relief."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrakit.functions import projection
from terrakit.functions.relief import slope_band
from terrakit.operators import cells, chain, contours, terrain
from terrakit.registry import query

c = F.col


def grid(t):
    return t.b_grid


def small_tiles(t, px=5):
    """Tiles of px x px samples out of consecutive parts; the last one may be short."""
    k = c("p_partkey") - 1
    rows = t.part.select(F.floor(k / (px * px)).alias("tile"), (k % (px * px)).alias("k"), c("p_retailprice").alias("z"))
    return rows.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("k", "z"))).alias("s")).select(
        (2600 + c("tile") % 7).cast("int").alias("e_km"), (1200 + F.floor(c("tile") / 7)).cast("int").alias("n_km"),
        F.transform("s", lambda x: x["z"].cast("float")).alias("samples"))


@query("j1_mosaic", "J1", sql="""
    with k as (select p_partkey-1 k, p_retailprice z from part), q as (select cast(floor(k/25) as int) tile, k%25 i, z from k),
    full_ as (select tile from q group by tile having count(*)=25)
    select (2600+tile%7)*5+i%5 c, (1200+cast(floor(tile/7) as int))*5+4-cast(floor(i/5) as int) r, round(z,2) z
    from q where tile in (select tile from full_)""")
def _(t):
    good, _ = terrain.valid_tiles(small_tiles(t), 5)
    return terrain.mosaic(good, 5).withColumn("z", F.round(c("z").cast("double"), 2))


@query("a12_tile_sizes", "A12", sql="""
    with q as (select (case when p_size=13 then -1 else 1 end)*(1+cast(floor((p_partkey-1)/25) as bigint)) tile, count(*) n from part group by 1)
    select n=25 usable, count(*) tiles, sum(n) samples from q group by 1""")
def _(t):
    # Samples of one size went astray, so their tiles and the tiles they left are short.
    tile = F.when(c("p_size") == 13, -1).otherwise(1) * (1 + F.floor((c("p_partkey") - 1) / 25))
    tiles = t.part.groupBy(tile.alias("tile")).agg(F.collect_list("p_retailprice").alias("samples"))
    good, others = terrain.valid_tiles(tiles, 5)
    both = good.withColumn("usable", F.lit(True)).unionByName(others.withColumn("usable", F.lit(False)))
    return both.groupBy("usable").agg(F.count(F.lit(1)).alias("tiles"), F.sum(F.size("samples")).alias("samples"))


SQUARES = """
    with s as (select a.c, a.r, a.z sw, b.z se, d.z nw, f.z ne from b_grid a join b_grid b on b.c=a.c+1 and b.r=a.r
      join b_grid d on d.c=a.c and d.r=a.r+1 join b_grid f on f.c=a.c+1 and f.r=a.r+1
      where a.z<>-9999 and b.z<>-9999 and d.z<>-9999 and f.z<>-9999),
    lv as (select unnest(generate_series(-200,2000,10)) "level"),
    m as (select s.*, "level", (case when sw>="level" then 1 else 0 end)+(case when se>="level" then 2 else 0 end)
        +(case when ne>="level" then 4 else 0 end)+(case when nw>="level" then 8 else 0 end) k from s cross join lv),
    x as (select *, case when se=sw then 0.5e0 else ("level"-sw)/(se-sw) end fs, case when ne=se then 0.5e0 else ("level"-se)/(ne-se) end fe,
        case when ne=nw then 0.5e0 else ("level"-nw)/(ne-nw) end fn, case when nw=sw then 0.5e0 else ("level"-sw)/(nw-sw) end fw
      from m where k not in (0,15))
"""
# Both diagonal pairs of a saddle have the same number of segments; lengths are compared
# for the other cases.
SQUARE_LENGTHS = """
    select "level", k "case", case when k in (5,10) then 2 else 1 end * count(*) segments,
      round(sum(case when k in (1,14) then sqrt(fs*fs+fw*fw) when k in (2,13) then sqrt((1-fs)*(1-fs)+fe*fe)
        when k in (3,12) then sqrt(1+(fe-fw)*(fe-fw)) when k in (4,11) then sqrt((1-fn)*(1-fn)+(1-fe)*(1-fe))
        when k in (6,9) then sqrt(1+(fn-fs)*(fn-fs)) when k in (7,8) then sqrt(fn*fn+(1-fw)*(1-fw)) else 0 end),4) length
    from x group by "level", k"""


@query("j2_marching_squares", "J2 D18", uses="b_grid", sql=SQUARES + SQUARE_LENGTHS)
def _(t):
    seg = terrain.march(terrain.cells2x2(grid(t)), terrain.interval_levels(10))
    run = F.hypot(c("be") - c("ae"), c("bn") - c("an"))
    return seg.groupBy("level", "case").agg(
        F.count(F.lit(1)).alias("segments"),
        F.round(F.sum(F.when(c("case").isin(5, 10), 0.0).otherwise(run)), 4).alias("length"))


@query("j2_marched_tiles", "J2 J1 D18", sql="""
    with k as (select p_partkey-1 k, p_retailprice z from part), q as (select cast(floor(k/25) as int) tile, k%25 i, z from k),
    full_ as (select tile from q group by tile having count(*)=25),
    m as (select (2600+tile%7)*5+i%5 c, (1200+cast(floor(tile/7) as int))*5+4-cast(floor(i/5) as int) r, cast(z as float) z
      from q where tile in (select tile from full_)),
    s as (select a.c, a.r, a.z sw, b.z se, d.z nw, f.z ne from m a join m b on b.c=a.c+1 and b.r=a.r
      join m d on d.c=a.c and d.r=a.r+1 join m f on f.c=a.c+1 and f.r=a.r+1),
    lv as (select unnest(generate_series(0,4000,10)) "level"),
    x as (select "level", (case when sw>="level" then 1 else 0 end)+(case when se>="level" then 2 else 0 end)
        +(case when ne>="level" then 4 else 0 end)+(case when nw>="level" then 8 else 0 end) k from s cross join lv)
    select "level", k "case", case when k in (5,10) then 2 else 1 end * count(*) segments from x where k not in (0,15) group by "level", k""")
def _(t):
    good, _ = terrain.valid_tiles(small_tiles(t), 5)
    seg = terrain.march(terrain.tile_cells(good, 10, px=5), terrain.interval_levels(10))
    return seg.groupBy("level", "case").agg(F.count(F.lit(1)).alias("segments"))


@query("j2_levels_scanned", "J3", uses="b_grid", sql="""
    with e as (select min(z) lo, max(z) hi from b_grid where z<>-9999),
    f as (select cast(floor(trunc(lo)/20)*20 as int) "first", cast(floor(trunc(hi)/20)*20 as int) "last" from e)
    select "first", "last", cast(("last"-"first")/20+1 as bigint) levels from f""")
def _(t):
    return terrain.levels_scanned(grid(t), 20).select(
        c("first").cast("int").alias("first"), c("last").cast("int").alias("last"), "levels")


@query("j3_contours", "J3 D17 B16")
def _(t):
    lines = contours.contour_lines(grid(t), 20, simplify_m=0.5, cell_m=2.0)
    return lines.groupBy("line", "level", "tier", "closed").agg(F.count(F.lit(1)).alias("points"))


@query("d17_chained_tracks", "D17", uses="b_tracks", sql="""
    select count(*)-count(distinct user_id) segments from b_tracks""")
def _(t):
    from terrakit.operators.lines import segments
    steps = segments(t.b_tracks, "user_id").filter("ae is not null")
    named = steps.select((c("user_id") * 100000000 + c("i")).alias("sid"), "ae", "an", c("e").alias("be"), c("n").alias("bn"))
    chained = chain.chain_any(named)
    # Every segment is in exactly one place of one line.
    return chained.agg(F.count_distinct("sid").alias("segments"))


HORN = """
    with z as (select c, r, case when z>-9999 then z end z from b_grid),
    b as (select min(c) c0, max(c) c1, min(r) r0, max(r) r1 from z),
    o as (select z.c, z.r, dx, dy, n.z from z cross join b cross join (values (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) v(dx,dy)
      left join z n on n.c=least(greatest(z.c+dx,c0),c1) and n.r=least(greatest(z.r+dy,r0),r1)),
    p as (select c, r, count(z) n, sum(case dx when 1 then z when -1 then -z else 0 end * case dy when 0 then 2 else 1 end)/80e0 gx,
      sum(case dy when 1 then z when -1 then -z else 0 end * case dx when 0 then 2 else 1 end)/80e0 gy from o group by c, r),
    s as (select c, r, case when n=9 then degrees(atan(sqrt(gx*gx+gy*gy))) else 0 end degrees from p)
"""


@query("j4_slope_field", "J4 D18", uses="b_grid", sql=HORN + "select c, r, round(degrees,4) degrees from s")
def _(t):
    field = grid(t).withColumn("z", F.when(c("z") > -9999, c("z")))
    return terrain.horn_slope(field, 10.0).withColumn("degrees", F.round("degrees", 4))


@query("j5_slope_areas", "J5 D17")
def _(t):
    field = terrain.horn_slope(grid(t).withColumn("z", F.when(c("z") > -9999, c("z") * 8)), 10.0)
    return contours.slope_areas(field).groupBy("line", "min_deg").agg(F.count(F.lit(1)).alias("points"))


@query("j6_slope_classes", "J6", uses="b_grid", sql=HORN + """
    select case when degrees>=50 then 50 when degrees>=45 then 45 when degrees>=40 then 40 when degrees>=35 then 35
      when degrees>=30 then 30 else 0 end band, count(*) n from s group by 1""")
def _(t):
    field = grid(t).withColumn("z", F.when(c("z") > -9999, c("z")))
    return terrain.horn_slope(field, 10.0).groupBy(slope_band(c("degrees")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


_E, _N = projection.lv95_sql("lon", "lat")
RELIEF = f"""
    with g as (select c+1305 c, r+595 r, z from b_grid),
    q as (select la lat0, lo lon0, i, j, lo+j*(1e0/60) lon, la+1-i*(1e0/60) lat from (values (46,7),(46,8),(47,7)) v(la,lo)
      cross join range(61) a(i) cross join range(61) b(j)),
    p as (select *, {_E}/2000e0-0.5e0 fx, {_N}/2000e0-0.5e0 fy from q),
    k as (select p.*, fx-floor(fx) tx, fy-floor(fy) ty, a.z sw, b.z se, d.z nw, f.z ne from p
      left join g a on a.c=floor(fx) and a.r=floor(fy) left join g b on b.c=floor(fx)+1 and b.r=floor(fy)
      left join g d on d.c=floor(fx) and d.r=floor(fy)+1 left join g f on f.c=floor(fx)+1 and f.r=floor(fy)+1),
    h as (select lat0 lat, lon0 lon, i "row", j col, case when sw is null or se is null or nw is null or ne is null
        or sw=-9999 or se=-9999 or nw=-9999 or ne=-9999 then -32768
      else cast(least(greatest(round((sw*(1-tx)+se*tx)*(1-ty)+(nw*(1-tx)+ne*tx)*ty),-1000),9000) as int) end h from k)
"""


def relief(t):
    placed = grid(t).select((c("c") + 1305).alias("c"), (c("r") + 595).alias("r"), "z")
    goal = t.values("values (46, 7), (46, 8), (47, 7) as v(lat, lon)")
    return terrain.relief_raster(placed, goal, 61, 2000.0)


@query("j7_relief_raster", "J7 A14", uses="b_grid", sql=RELIEF + 'select lat, lon, "row", col, h from h')
def _(t):
    return relief(t)


@query("e11_relief_coverage", "E11", uses="b_grid", sql=RELIEF + """
    select lat, lon, count(*) filter (h<>-32768) filled, count(*) filter (h=-32768) void,
      round(count(*) filter (h<>-32768)/count(*)::double,6) coverage from h group by 1,2""")
def _(t):
    return terrain.coverage(relief(t)).withColumn("coverage", F.round("coverage", 6))


@query("j8_covering_cells", "J8", uses="b_segments", sql="""
    with b as (select sid, least(ax,bx) e0, least(ay,b_y) n0, greatest(ax,bx) e1, greatest(ay,b_y) n1 from b_segments)
    select sid, (greatest(cast(ceil(e1/1000) as int)-1, cast(floor(e0/1000) as int))-cast(floor(e0/1000) as int)+1)
      * (greatest(cast(ceil(n1/1000) as int)-1, cast(floor(n0/1000) as int))-cast(floor(n0/1000) as int)+1) cells,
      cast(floor(e0/1000) as int) min_e_km, cast(floor(n0/1000) as int) min_n_km from b""")
def _(t):
    box = cells.covering(F.least("ax", "bx"), F.least("ay", "b_y"), F.greatest("ax", "bx"), F.greatest("ay", "b_y"))
    return t.b_segments.select("sid", F.inline(box)).groupBy("sid").agg(
        F.count(F.lit(1)).alias("cells"), F.min("e_km").alias("min_e_km"), F.min("n_km").alias("min_n_km"))


@query("j8_degree_cells", "J8", uses="b_segments", sql=f"""
    with v as (select sid, e, n from b_segments cross join lateral (values (least(ax,bx),least(ay,b_y)),(least(ax,bx),greatest(ay,b_y)),
      (greatest(ax,bx),least(ay,b_y)),(greatest(ax,bx),greatest(ay,b_y))) q(e,n)),
    d as (select sid, cast(floor(min({projection.wgs84_sql('e', 'n')[0]})) as int) w, cast(floor(min({projection.wgs84_sql('e', 'n')[1]})) as int) s,
      cast(floor(max({projection.wgs84_sql('e', 'n')[0]})) as int) ea, cast(floor(max({projection.wgs84_sql('e', 'n')[1]})) as int) no from v group by sid)
    select sid, unnest(generate_series(w, ea)) lon, s lat from d where s=no
    union all select sid, lon, unnest(generate_series(s, no)) from (select sid, s, no, unnest(generate_series(w, ea)) lon from d where s<>no) q""")
def _(t):
    frame = projection.box_to_wgs84(F.least("ax", "bx"), F.least("ay", "b_y"), F.greatest("ax", "bx"), F.greatest("ay", "b_y"))
    return t.b_segments.select("sid", F.inline(cells.degree_cells(*frame)))


@query("e9_elevation_range", "E9", uses="b_grid", sql="select min(z) lo, max(z) hi from b_grid where z<>-9999")
def _(t):
    return terrain.elevation_range(grid(t))


@query("e10_block_means", "E10", uses="b_grid", sql="""
    with b as (select min(c) c0, min(r) r0, max(c)-min(c)+1 w, max(r)-min(r)+1 h from b_grid)
    select cast(floor((c-c0)/3) as int) c, cast(floor((r-r0)/3) as int) r, round(avg(case when z>-9999 then z end),6) z
    from b_grid, b where floor((c-c0)/3)<floor(w/3) and floor((r-r0)/3)<floor(h/3) group by 1,2""")
def _(t):
    return terrain.block_means(grid(t), 3).withColumn("z", F.round("z", 6))
