"""Attribute joins and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrakit.functions import attrs, projection, shapes
from terrakit.operators import spatial
from terrakit.plans import areas, devices, layers
from terrakit.queries.geometry import AREA_SQL, LAT, LON, area_table, rings
from terrakit.registry import query
from terrakit.session import dealt

c = F.col

# Squared distance of (e,n) to segment (ax,ay)-(bx,b_y) as SQL text.
SEG_T = """case when (bx-ax)=0 and (b_y-ay)=0 then 0 else least(greatest(((e-ax)*(bx-ax)+(n-ay)*(b_y-ay))
    /((bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay)),0),1) end"""
SEG_D2 = f"((e-ax-({SEG_T})*(bx-ax))*(e-ax-({SEG_T})*(bx-ax))+(n-ay-({SEG_T})*(b_y-ay))*(n-ay-({SEG_T})*(b_y-ay)))"
# Polygon edges and the ray test, for b_polys.
EDGES = """edge as (select poly, e ae, n an, lead(e) over w be, lead(n) over w bn from b_polys
    window w as (partition by poly order by i))"""
HITS = """sum(case when be is not null and ((an>n)<>(bn>n)) and e < (ae-be)*(n-bn)/nullif(an-bn,0)+be then 1 else 0 end)%2=1"""


def segments(t):
    return t.b_segments.withColumnRenamed("b_y", "by")


def poly_rings(t):
    return rings(t).select(c("poly").cast("bigint").alias("mask_id"), c("poly").cast("bigint").alias("poly"), "ring", "pts")


@query("d1_index_then_box", "D1", uses="b_points", sql="""
    select c_custkey id, c_name from customer join b_points on id=c_custkey
    where e between 2550000 and 2650000 and n between 1100000 and 1200000""")
def _(t):
    box = t.b_points.filter(c("e").between(2550000, 2650000) & c("n").between(1100000, 1200000)).select("id")
    return t.customer.select(c("c_custkey").alias("id"), "c_name").join(box, "id", "left_semi")


@query("d2_points_in_polygons", "D2", uses="b_points b_polys", sql=f"""
    with {EDGES} select id, poly from b_points cross join edge group by id, poly having {HITS}""")
def _(t):
    return spatial.in_polygons(t.b_points, poly_rings(t), size=5000.0).select("id", "poly")


@query("d3_points_near_routes", "D3 C1", uses="b_points b_segments", sql=f"""
    select id, e, n, round({LON},7) lon, round({LAT},7) lat from b_points
    where exists (select 1 from b_segments where {SEG_D2} <= 1e8)""")
def _(t):
    near = spatial.within_distance(t.b_points, segments(t), 10000.0)
    lon, lat = projection.to_wgs84(c("e"), c("n"))
    return near.select("id", "e", "n", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("d4_buffered_polygons", "D4", uses="b_points b_polys", sql=f"""
    with {EDGES}, inn as (select id, poly from b_points cross join edge group by id, poly having {HITS}),
    s as (select poly, ae ax, an ay, be bx, bn b_y from edge where be is not null),
    near as (select distinct id, poly from b_points cross join s where {SEG_D2} <= 9e6)
    select id, poly mask_id from inn union select id, poly from near""")
def _(t):
    shapes_ = poly_rings(t)
    band = spatial.boundary_segments(shapes_, F.lit(3000.0))
    return spatial.members(t.b_points, shapes_, band, size=2000.0).select("id", "mask_id")


@query("d5_union_masks", "D5", uses="b_points", sql=AREA_SQL + f"""
    , ok as (select area_id from b group by area_id having bool_and(k>=2)),
    seg as (select b.area_id, e ax, n ay, e bx, n b_y, r*r r2 from b join ok on b.area_id=ok.area_id where k=2
      union all select b.area_id, e, n, e+3000, n+1000, 250000 from b join ok on b.area_id=ok.area_id where k=3
      union all select b.area_id, e+3000, n+1000, e+4000, n-2000, 250000 from b join ok on b.area_id=ok.area_id where k=3),
    near as (select distinct p.id, area_id from b_points p cross join seg where {SEG_D2} <= r2),
    tri as (select b.area_id, e x0, n y0 from b join ok on b.area_id=ok.area_id where k=4),
    te as (select area_id, x0 ae, y0 an, x0+3000 be, y0+1000 bn, x0 k from tri union all
      select area_id, x0+3000, y0+1000, x0+4000, y0-2000, x0 from tri union all
      select area_id, x0+4000, y0-2000, x0, y0, x0 from tri),
    inn as (select p.id, area_id from b_points p join te on p.e between k-1 and k+4001 group by p.id, area_id, k having
      sum(case when ((an>n)<>(bn>n)) and e < (be-ae)*(n-an)/nullif(bn-an,0)+ae then 1 else 0 end)%2=1)
    select area_id, id from near union select area_id, id from inn""")
def _(t):
    table = area_table(t)
    masked = areas.extents(table).filter("masked").select("area_id")
    parts = table.join(masked, "area_id", "left_semi")
    return spatial.members(t.b_points, areas.mask_rings(parts), areas.mask_segments(parts)).select(
        c("mask_id").alias("area_id"), "id")


@query("c17_admin_masks", "C17 D5", uses="b_points b_polys", sql=f"""
    with {EDGES}, unit as (select n_nationkey number, case when n_regionkey=4 then 'canton' else 'commune' end lvl from nation
      where n_nationkey%11<>3 and (n_regionkey=4 or n_nationkey%7<>0)),
    part as (select n_regionkey area_id, case when n_regionkey=4 then 'canton' else 'commune' end lvl, n_nationkey number,
      (n_regionkey%2)*2000.0 r from nation
      union all select 100+r_regionkey, 'canton', 1000+r_regionkey, 0 from region),
    met as (select area_id, part.number, r from part join unit on part.number=unit.number and part.lvl=unit.lvl),
    inn as (select area_id, id, poly from met join edge on poly=number cross join b_points group by area_id, id, poly having {HITS}),
    s as (select area_id, r, ae ax, an ay, be bx, bn b_y from met join edge on poly=number where be is not null and r>0),
    near as (select distinct area_id, id from b_points cross join s where {SEG_D2} <= r*r)
    select area_id, id, cast(null as varchar) reason from (select area_id, id from inn union select area_id, id from near) q
    union all select distinct area_id, cast(null as bigint), 'no_such_unit level=' || lvl || ' numbers=' || number from part
      where area_id>=100""")
def _(t):
    level = F.when(c("n_regionkey") == 4, "canton").otherwise("commune")
    nation = t.nation.select(
        level.alias("level"), c("n_nationkey").cast("bigint").alias("number"), "n_regionkey",
        F.when(c("n_nationkey") % 11 == 3, "LI").otherwise("CH").alias("icc"),
        F.when(c("n_nationkey") % 7 == 0, "Kantonsgebiet").otherwise("Gemeindegebiet").alias("objektart"))
    units = nation.join(poly_rings(t).withColumnRenamed("mask_id", "number"), "number")
    regions = nation.groupBy(c("n_regionkey").cast("bigint").alias("area_id"), "level").agg(
        F.sort_array(F.collect_set("number")).alias("numbers"))
    empty = t.region.select(
        (c("r_regionkey") + 100).cast("bigint").alias("area_id"), F.lit("canton").alias("level"),
        F.array((c("r_regionkey") + 1000).cast("bigint")).alias("numbers"))
    parts = regions.unionByName(empty).select(
        "*", F.lit(0).alias("part"), F.lit("adminUnits").alias("kind"),
        F.when(c("area_id") < 100, (c("area_id") % 2) * 2.0).otherwise(0.0).alias("buffer_km"))
    shaped, band, unknown = areas.unit_masks(parts, units)
    inside = spatial.members(t.b_points, shaped, band, size=5000.0)
    return inside.select(c("mask_id").alias("area_id"), c("id").cast("bigint").alias("id"), F.lit(None).cast("string").alias("reason")).unionByName(
        unknown.select("area_id", F.lit(None).cast("bigint").alias("id"), "reason"))


@query("d6_any_vertex_inside", "D6", uses="b_segments b_polys", sql=f"""
    with {EDGES}, v as (select sid, 0 k, ax e, ay n from b_segments union all select sid, 1, bx, b_y from b_segments),
    h as (select sid, k, poly from v cross join edge group by sid, k, poly having {HITS})
    select distinct sid, poly mask_id from h""")
def _(t):
    vertices = segments(t).select(c("sid").alias("id"), F.inline(F.array(
        shapes.point(c("ax"), c("ay")), shapes.point(c("bx"), c("by")))))
    return spatial.members(vertices, poly_rings(t), None, size=5000.0).select(c("id").alias("sid"), "mask_id")


@query("d7_relabelled", "D7 F6", uses="b_names", sql="""
    select p_partkey uuid, coalesce(trim(n.name), p_name) name from part left join
      (select * from b_names where starts_with(code,'Hochdeutsch') and trim(name)<>'') n on n.uuid=p_partkey""")
def _(t):
    from terrakit.sources.names import first_names, in_language, relabel
    register = first_names(in_language(t.b_names, "german"), ["uuid"]).withColumn("name", F.trim("name"))
    return relabel(t.part.select(c("p_partkey").alias("uuid"), c("p_name").alias("name")), register)


@query("d8_canton_names", "D8", sql="""
    select n_nationkey number, n_name name, coalesce(r_name,'') canton from nation
    left join (select case when r_regionkey=2 then 99 else r_regionkey end k, r_name from region) r on k=n_regionkey""")
def _(t):
    from terrakit.plans.units import with_canton
    units = t.nation.select(c("n_nationkey").alias("number"), c("n_name").alias("name"), c("n_regionkey").alias("canton_number"))
    # One canton has a number that no unit carries.
    cantons = t.region.select(F.when(c("r_regionkey") == 2, 99).otherwise(c("r_regionkey")).alias("number"), c("r_name").alias("name"))
    return with_canton(units, cantons).select("number", "name", "canton")


@query("d9_device_profiles", "D9", sql="""
    with r as (select c_custkey request, case c_custkey%4 when 0 then ' Edge 840 ' when 1 then 'FENIX 7'
      when 2 then 'Etrex ' || cast(c_custkey as varchar) else 'edge 1040' end model, c_custkey%3=0 wrist from customer)
    select request, case lower(trim(model)) when 'edge 840' then 'edge-840' when 'fenix 7' then 'fenix-7'
      when 'edge 1040' then 'edge-1040' else case when wrist then 'generic-fenix' else 'generic-edge' end end profile from r""")
def _(t):
    k = c("c_custkey")
    model = (F.when(k % 4 == 0, " Edge 840 ").when(k % 4 == 1, "FENIX 7")
             .when(k % 4 == 2, F.concat(F.lit("Etrex "), k.cast("string"))).otherwise("edge 1040"))
    requests = t.customer.select(k.alias("request"), model.alias("model"), (k % 3 == 0).alias("wrist"))
    profiles = t.values("""values (0,'edge-840',array('Edge 840')),(1,'fenix-7',array('fenix 7','fenix 7S')),
        (2,'edge-1040',array('Edge 1040','edge 840')),(3,'generic-edge',array('')),(4,'generic-fenix',array('')) as v(pos,profile,models)""")
    return devices.match_profiles(requests, profiles)


@query("d10_contours_on_ice", "D10", uses="b_segments b_polys", sql=f"""
    with {EDGES}, m as (select sid, (ax+bx)/2 e, (ay+b_y)/2 n from b_segments),
    h as (select sid, poly from m cross join edge group by sid, poly having {HITS})
    select sid, sid in (select sid from h) on_ice from b_segments""")
def _(t):
    from terrakit.operators.contours import flag_on_ice
    pts = F.array(shapes.point(c("ax"), c("ay")), shapes.point((c("ax") + c("bx")) / 2, (c("ay") + c("by")) / 2),
                  shapes.point(c("bx"), c("by")))
    return flag_on_ice(segments(t).select("sid", pts.alias("pts")), "sid", poly_rings(t), size=5000.0).select("sid", "on_ice")


@query("d11_cells_a_mask_needs", "D11 H2 H4 G3 K7", uses="b_segments", sql=f"""
    with a as (select *, least(ax,bx)-3000 e0, least(ay,b_y)-3000 n0, greatest(ax,bx)+3000 e1, greatest(ay,b_y)+3000 n1 from b_segments),
    x as (select *, unnest(generate_series(cast(floor(e0/1000) as bigint), greatest(cast(ceil(e1/1000) as bigint)-1, cast(floor(e0/1000) as bigint)))) e_km from a),
    box as (select *, unnest(generate_series(cast(floor(n0/1000) as bigint), greatest(cast(ceil(n1/1000) as bigint)-1, cast(floor(n0/1000) as bigint)))) n_km from x),
    pr as (select box.*, (e_km+dx)*1000 e, (n_km+dy)*1000 n from box cross join (values (0,0),(1,0),(0,1),(1,1),(0.5e0,0.5e0)) v(dx,dy)),
    kept as (select distinct sid, e_km, n_km from pr where {SEG_D2} <= 9e6),
    grown as (select distinct sid, e_km+dx e_km, n_km+dy n_km from kept cross join
      (values (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) v(dx,dy))
    select g.sid area_id, g.e_km, g.n_km from grown g join box b on g.sid=b.sid and g.e_km=b.e_km and g.n_km=b.n_km""")
def _(t):
    from terrakit.plans.coverage import cells_needed
    return cells_needed(*corridor_areas(t, 3000.0))


def corridor_areas(t, buffer_m):
    """Each segment as a corridor area: (extents, rings, segments)."""
    s = segments(t)
    extents = s.select(
        c("sid").alias("area_id"), (F.least("ax", "bx") - buffer_m).alias("min_e"), (F.least("ay", "by") - buffer_m).alias("min_n"),
        (F.greatest("ax", "bx") + buffer_m).alias("max_e"), (F.greatest("ay", "by") + buffer_m).alias("max_n"))
    segs = s.select(c("sid").alias("mask_id"), F.lit(buffer_m).alias("radius"), "ax", "ay", "bx", "by")
    return extents, None, segs


@query("d12_missing_tiles", "D12", uses="b_points b_assets", sql="""
    with w as (select distinct cast(floor(e/1000) as int) e_km, cast(floor(n/1000) as int) n_km from b_points),
    h as (select distinct cast(substr(name,18,4) as int) e_km, cast(substr(name,23,4) as int) n_km from b_assets)
    select w.e_km, w.n_km from w left join h on w.e_km=h.e_km and w.n_km=h.n_km where h.e_km is null""")
def _(t):
    from terrakit.operators.newest import missing_cells
    wanted = t.b_points.select(F.floor(c("e") / 1000).cast("int").alias("e_km"), F.floor(c("n") / 1000).cast("int").alias("n_km"))
    have = t.b_assets.select(attrs.tile_e_km(c("name")).alias("e_km"), attrs.tile_n_km(c("name")).alias("n_km"))
    return missing_cells(wanted, have)


@query("d13_nearest_distances", "D13", uses="b_points b_segments", sql="""
    with v as (select sid*2 id, ax e, ay n from b_segments union all select sid*2+1, bx, b_y from b_segments)
    select v.id, round(min(sqrt((p.e-v.e)*(p.e-v.e)+(p.n-v.n)*(p.n-v.n))),3) distance from v cross join b_points p group by v.id""")
def _(t):
    s = segments(t)
    ends = s.select((c("sid") * 2).alias("id"), c("ax").alias("e"), c("ay").alias("n")).unionByName(
        s.select((c("sid") * 2 + 1).alias("id"), c("bx").alias("e"), c("by").alias("n")))
    return spatial.nearest_distance(ends, t.b_points).withColumn("distance", F.round("distance", 3))


@query("d14_house_numbers", "D14", uses="b_addresses b_points", sql=f"""
    with street as (select id sid, lower(stn_label) label, e+100+(id%2)*300 ax, n+50 ay, e+700 bx, n+80 b_y
      from (select id, e, n from b_points) p join (select id, stn_label from b_addresses) a using (id)),
    adr as (select id, lower(stn_label) label, e, n from b_points join (select id, stn_label from b_addresses) a using (id)),
    d as (select adr.id, sid, {SEG_D2} d2 from adr join street on adr.label=street.label)
    select id, min(sid) street, round(sqrt(d2),3) distance from
      (select *, min(d2) over (partition by id) m from d where d2<=22500) q where d2=m group by id, d2""")
def _(t):
    from terrakit.operators.housenumbers import nearest_street
    a = t.b_addresses.select("id", "stn_label").join(t.b_points, "id")
    streets = a.select(c("id").alias("sid"), c("stn_label").alias("street"), (c("e") + 100 + (c("id") % 2) * 300).alias("ax"),
                       (c("n") + 50).alias("ay"), (c("e") + 700).alias("bx"), (c("n") + 80).alias("by"))
    found = nearest_street(a.select("id", c("stn_label").alias("street"), "e", "n"), streets)
    return found.select("id", c("sid").alias("street"), F.round("distance", 3).alias("distance"))


_PE, _PN = projection.lv95_sql("lon", "lat")


@query("d15_raster_tiles_kept", "D15", uses="b_segments", sql=f"""
    with v as (select sid, ax, ay, bx, b_y, e, n from b_segments cross join lateral (values (least(ax,bx)-1000, least(ay,b_y)-1000),
        (least(ax,bx)-1000, greatest(ay,b_y)+1000),(greatest(ax,bx)+1000, least(ay,b_y)-1000),(greatest(ax,bx)+1000, greatest(ay,b_y)+1000)) q(e,n)),
    x as (select sid, ax, ay, bx, b_y, min({LON}) w, min({LAT}) s, max({LON}) ea, max({LAT}) no from v group by all),
    tl as (select *, w+(ea-w)*tc/4 tw, s+(no-s)*tr/4 ts from x cross join range(4) a(tc) cross join range(4) b(tr)),
    p as (select sid, ax, ay, bx, b_y, tc, tr, tw+(ea-w)/4*i/8 lon, ts+(no-s)/4*j/8 lat from tl cross join range(9) a(i) cross join range(9) b(j)),
    m as (select *, {_PE} e, {_PN} n from p)
    select sid area_id, tc col, tr "row" from m group by sid, tc, tr having bool_or({SEG_D2} <= 1e6)""")
def _(t):
    from terrakit.plans.raster import touched
    extents, _, segs = corridor_areas(t, 1000.0)
    west, south, east, north = projection.box_to_wgs84(c("min_e"), c("min_n"), c("max_e"), c("max_n"))
    grid = F.sequence(F.lit(0), F.lit(3))
    frames = extents.select("area_id", west.alias("w"), south.alias("s"), east.alias("e"), north.alias("n"))
    tiles = (dealt(frames).withColumn("col", F.explode(grid)).withColumn("row", F.explode(grid)))
    w, s = (c("e") - c("w")) / 4, (c("n") - c("s")) / 4
    tiles = tiles.select("area_id", "col", "row", (c("w") + w * c("col")).alias("west"), (c("s") + s * c("row")).alias("south"),
                         (c("w") + w * (c("col") + 1)).alias("east"), (c("s") + s * (c("row") + 1)).alias("north"))
    return touched(tiles, None, segs).select("area_id", "col", "row")


@query("d16_shared_nodes", "D16 F8 A13", uses="b_tracks", sql=f"""
    with p as (select floor(e/2000)*2000 e, floor(n/2000)*2000 n from b_tracks),
    q as (select cast(round({LON}*1e7) as int) lon_e7, cast(round({LAT}*1e7) as int) lat_e7 from p),
    g as (select lon_e7, lat_e7, count(*) vertices from q group by 1,2)
    select row_number() over (order by lon_e7, lat_e7) node, lon_e7, lat_e7, vertices from g""")
def _(t):
    from terrakit.sources.osm import quantised, shared_nodes
    coarse = t.b_tracks.select((F.floor(c("e") / 2000) * 2000.0).alias("e"), (F.floor(c("n") / 2000) * 2000.0).alias("n"))
    used = quantised(coarse).groupBy("lon_e7", "lat_e7").agg(F.count(F.lit(1)).alias("vertices"))
    return shared_nodes(coarse).join(used, ["lon_e7", "lat_e7"]).select("node", "lon_e7", "lat_e7", "vertices")


@query("a13_element_tables", "A13 F8", uses="b_segments", sql="""
    select count(*) way_nodes, count(distinct sid) ways from
    (select sid, 0 k from b_segments where ax<>bx or ay<>b_y union all select sid, 1 from b_segments where ax<>bx or ay<>b_y) q""")
def _(t):
    from terrakit.sources.osm import element_tables
    roads = segments(t).selectExpr(
        "'roads' layer", "sid id", "'LineString' kind",
        "array(named_struct('poly', 0, 'ring', 0, 'pts', array(named_struct('e', ax, 'n', ay), named_struct('e', bx, 'n', by)))) parts",
        "map('tlm:layer', 'roads') tags")
    made = element_tables(roads)
    return made["way_nodes"].agg(F.count(F.lit(1)).alias("way_nodes"), F.count_distinct("id").alias("ways"))


@query("d19_regions_to_build", "D19", sql="""
    with r as (select distinct o_custkey || '|' || o_orderstatus k, o_custkey cust from orders),
    done as (select distinct o_custkey || '|' || o_orderstatus k from orders where o_orderpriority like '1%'),
    st as (select distinct o_custkey || '|' || o_orderstatus k from orders where o_totalprice>100000)
    select k region from r where not (k in (select k from done) and k in (select k from st))""")
def _(t):
    from terrakit.plans.region import regions_to_build
    key = F.concat(c("o_custkey").cast("string"), F.lit("|"), "o_orderstatus").alias("region")
    wanted = t.orders.select(key).distinct()
    clips = t.orders.filter(c("o_orderpriority").startswith("1")).select(key).distinct()
    stats = t.orders.filter("o_totalprice > 100000").select(key).distinct()
    return regions_to_build(wanted, clips, stats)


@query("b26_region_keys", "B26 D19", sql="""
    with recursive k as (select c_custkey id, 'v4|' || c_name || '|' || c_mktsegment txt from customer),
    f(id, txt, i, h) as (
      select id, txt, 0, cast(14695981039346656037 as uhugeint) from k
      union all
      select id, txt, i+1, (xor(h, cast(ascii(substr(txt,i+1,1)) as uhugeint)) * cast(1099511628211 as uhugeint))
         % cast(18446744073709551616 as uhugeint) from f where i<length(txt))
    select id, lpad(lower(hex(cast(h as ubigint))),16,'0') region from f where i=length(txt)""")
def _(t):
    text = F.concat(F.lit("v4|"), "c_name", F.lit("|"), "c_mktsegment")
    return t.customer.select(c("c_custkey").alias("id"), attrs.fnv64(text).alias("region"))


@query("d20_layer_groups", "D20", sql="""
    with l as (select case p_partkey%5 when 0 then 'tlm_strassen_strasse' when 1 then 'ski_routes_2056'
       when 2 then 'tlm_gewaesser' when 3 then 'unknown' else 'VeloWeg' end layer from part)
    select layer, case layer when 'tlm_strassen_strasse' then 'transport' when 'ski_routes_2056' then 'winter'
      when 'tlm_gewaesser' then 'water' when 'VeloWeg' then 'cycling' end grp, count(*) n from l group by 1,2""")
def _(t):
    k = c("p_partkey") % 5
    name = (F.when(k == 0, "tlm_strassen_strasse").when(k == 1, "ski_routes_2056").when(k == 2, "tlm_gewaesser")
            .when(k == 3, "unknown").otherwise("VeloWeg"))
    counts = t.part.groupBy(name.alias("layer")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(layers.groups_of(counts.select("layer"), layers.layer_specs(t.spark)), "layer").select("layer", "grp", "n")


@query("h3_layers_missing", "H3 B6", uses="b_features", sql="""
    select spec from (values ('roads'),('cover'),('tracks'),('names'),('huts')) v(spec)
    where not exists (select 1 from b_features where starts_with(layer, spec))""")
def _(t):
    specs = t.values("values ('roads'),('cover'),('tracks'),('names'),('huts') as v(spec)")
    return layers.missing_layers(specs, t.b_features.select("layer").distinct())
