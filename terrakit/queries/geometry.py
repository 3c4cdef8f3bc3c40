"""Operators on geometry columns and on point tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrakit.functions import boxes, projection, shapes
from terrakit.operators import lines, simplify
from terrakit.plans import areas
from terrakit.registry import query

LON, LAT = projection.wgs84_sql("e", "n")
c = F.col


def rings(t):
    """Closed squares, five points per row: (poly, ring, pts)."""
    return t.b_polys.groupBy("poly", "ring").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "e", "n"))),
                    lambda p: shapes.point(p["e"], p["n"])).alias("pts"))


@query("c1_to_wgs84", "C1", uses="b_points",
       sql=f"select id, round({LON},7) lon, round({LAT},7) lat from b_points")
def _(t):
    lon, lat = projection.to_wgs84(c("e"), c("n"))
    return t.b_points.select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


_E, _N = projection.lv95_sql("lon", "lat")


@query("c2_to_lv95", "C2", uses="b_points", sql=f"""
    with d as (select id, 6e0+(e-2480000)/90000 lon, 46e0+(n-1070000)/130000 lat from b_points)
    select id, round({_E},3) e, round({_N},3) n from d""")
def _(t):
    d = t.b_points.select("id", (6.0 + (c("e") - 2480000) / 90000).alias("lon"),
                          (46.0 + (c("n") - 1070000) / 130000).alias("lat"))
    e, n = projection.to_lv95(c("lon"), c("lat"))
    return d.select("id", F.round(e, 3).alias("e"), F.round(n, 3).alias("n"))


@query("c3_box_to_wgs84", "C3", uses="b_points", sql=f"""
    with corner as (select id, e+dx e, n+dy n from (select id, e, n from b_points) p
      cross join (values (-5000,-3000),(5000,-3000),(-5000,3000),(5000,3000)) v(dx,dy)),
    d as (select id, {LON} lon, {LAT} lat from corner)
    select id, round(min(lon),7) west, round(min(lat),7) south, round(max(lon),7) east, round(max(lat),7) north
    from d group by id""")
def _(t):
    frame = projection.box_to_wgs84(c("e") - 5000, c("n") - 3000, c("e") + 5000, c("n") + 3000)
    return t.b_points.select("id", *[F.round(x, 7).alias(k) for x, k in zip(frame, ("west", "south", "east", "north"))])


@query("c4_geometry_boxes", "C4", uses="b_polys b_tracks", sql="""
    select 'poly' kind, cast(poly as bigint) id, min(e) min_e, min(n) min_n, max(e) max_e, max(n) max_n from b_polys group by poly
    union all select 'track', user_id, min(e), min(n), max(e), max(n) from b_tracks group by user_id""")
def _(t):
    polys = rings(t).select(F.lit("poly").alias("kind"), c("poly").cast("bigint").alias("id"),
                            F.inline(F.array(shapes.bounds(c("pts")))))
    tracks = t.b_tracks.groupBy(c("user_id").alias("id")).agg(
        F.min("e").alias("min_e"), F.min("n").alias("min_n"), F.max("e").alias("max_e"), F.max("n").alias("max_n"))
    return polys.unionByName(tracks.withColumn("kind", F.lit("track")))


@query("c5_track_lengths", "C5", uses="b_tracks", sql="""
    with s as (select user_id, e, n, lag(e) over w ae, lag(n) over w an from b_tracks window w as (partition by user_id order by i))
    select user_id, round(coalesce(sum(sqrt((e-ae)*(e-ae)+(n-an)*(n-an))),0),3) length_m, count(*) points from s group by user_id""")
def _(t):
    return lines.lengths(t.b_tracks, "user_id").withColumn("length_m", F.round("length_m", 3))


@query("c6_ring_areas", "C6", uses="b_polys", sql="""
    with s as (select poly, e, n, lead(e) over w be, lead(n) over w bn from b_polys window w as (partition by poly order by i)),
    a as (select poly, sum(e*bn-be*n)/2 signed from s where be is not null group by poly)
    select poly, round(signed,3) signed,
      round(greatest(abs(signed) - case when poly%3=0 then abs(signed)*0.25e0 else 0 end, 0),3) area from a""")
def _(t):
    # Every third polygon gets a hole of half its width and height in its lower left corner.
    p0 = c("pts")[0]
    hole = F.transform(c("pts"), lambda p: shapes.point(p0["e"] + (p["e"] - p0["e"]) / 2, p0["n"] + (p["n"] - p0["n"]) / 2))
    parts = F.when(c("poly") % 3 == 0, F.array(c("pts"), hole)).otherwise(F.array(c("pts")))
    return rings(t).select("poly", F.round(shapes.signed_area(c("pts")), 3).alias("signed"),
                           F.round(shapes.polygon_area(parts), 3).alias("area"))


@query("c7_centroids", "C7", uses="b_polys", sql="""
    with s as (select poly, 0 flat, e, n, lead(e) over w be, lead(n) over w bn from b_polys window w as (partition by poly order by i)),
    a as (select poly, sum((e+be)*(e*bn-be*n))/(3*sum(e*bn-be*n)) e, sum((n+bn)*(e*bn-be*n))/(3*sum(e*bn-be*n)) n
          from s where be is not null group by poly),
    m as (select poly, avg(e) e from b_polys where i<3 group by poly),
    k as (select poly, min(n) n from b_polys group by poly)
    select a.poly, round(a.e,3) e, round(a.n,3) n, round(m.e,3) flat_e, round(k.n,3) flat_n
    from a join m on a.poly=m.poly join k on a.poly=k.poly""")
def _(t):
    flat = F.transform(F.slice("pts", 1, 3), lambda p: shapes.point(p["e"], c("pts")[0]["n"]))
    return rings(t).select("poly", shapes.centroid(c("pts")).alias("m"), shapes.centroid(flat).alias("f")).select(
        "poly", F.round("m.e", 3).alias("e"), F.round("m.n", 3).alias("n"),
        F.round("f.e", 3).alias("flat_e"), F.round("f.n", 3).alias("flat_n"))


@query("c8_point_in_own_polygon", "C8", uses="b_points b_polys", sql="""
    with p as (select c_custkey id, c_nationkey poly, b.e, b.n from customer join b_points b on b.id=c_custkey),
    s as (select poly, e ae, n an, lead(e) over w be, lead(n) over w bn from b_polys window w as (partition by poly order by i)),
    h as (select p.id, sum(case when ((s.an>p.n)<>(s.bn>p.n)) and
        p.e < (s.ae-s.be)*(p.n-s.bn)/nullif(s.an-s.bn,0)+s.be then 1 else 0 end) hits from p join s on p.poly=s.poly
        where s.be is not null group by p.id)
    select p.id, h.hits%2=1 inside from p join h on p.id=h.id""")
def _(t):
    points = t.customer.select(c("c_custkey").alias("id"), c("c_nationkey").alias("poly")).join(t.b_points, "id")
    return points.join(rings(t), "poly").select(
        "id", shapes.in_polygon(c("e"), c("n"), F.array("pts")).alias("inside"))


CLIP_BOX = (2604000.0, 1204000.0, 2613000.0, 1212000.0)


@query("c9_clipped_lines", "C9 F5", uses="b_tracks", sql="""
    with s as (select user_id, i, lag(e) over w ae, lag(n) over w an, e be, n bn from b_tracks
               window w as (partition by user_id order by i)),
    d as (select *, be-ae dx, bn-an dy from s where ae is not null),
    q as (select *, greatest(0, case when dx>0 then (2604000-ae)/dx when dx<0 then (2613000-ae)/dx else 0 end,
        case when dy>0 then (1204000-an)/dy when dy<0 then (1212000-an)/dy else 0 end) t0,
      least(1, case when dx>0 then (2613000-ae)/dx when dx<0 then (2604000-ae)/dx else 1 end,
        case when dy>0 then (1212000-an)/dy when dy<0 then (1204000-an)/dy else 1 end) t1 from d
      where not (dx=0 and (ae<2604000 or ae>2613000)) and not (dy=0 and (an<1204000 or an>1212000))),
    v as (select user_id, i, ae+t0*dx pe, an+t0*dy pn, ae+t1*dx qe, an+t1*dy qn from q where t0<=t1),
    b as (select *, case when lag(qe) over w = pe and lag(qn) over w = pn and lag(i) over w = i-1 then 0 else 1 end brk
          from v window w as (partition by user_id order by i)),
    g as (select *, cast(sum(brk) over (partition by user_id order by i) as bigint) part from b)
    select user_id, part, count(*)+1 points, round(sum(sqrt((qe-pe)*(qe-pe)+(qn-pn)*(qn-pn))),3) length_m
    from g group by 1,2""")
def _(t):
    seg = lines.clip_segments(t.b_tracks, "user_id", *CLIP_BOX)
    return seg.groupBy("user_id", "part").agg(
        (F.count(F.lit(1)) + 1).alias("points"),
        F.round(F.sum(F.sqrt((c("qe") - c("pe")) ** 2 + (c("qn") - c("pn")) ** 2)), 3).alias("length_m"))


@query("c10_clipped_rings", "C10", uses="b_polys", sql="""
    select poly, 5 points, greatest(min(e),2500000) min_e, greatest(min(n),1100000) min_n,
      least(max(e),2700000) max_e, least(max(n),1230000) max_n from b_polys group by poly
    having max(e)>2500000 and min(e)<2700000 and max(n)>1100000 and min(n)<1230000""")
def _(t):
    cut = shapes.clip_ring(c("pts"), F.lit(2500000.0), F.lit(1100000.0), F.lit(2700000.0), F.lit(1230000.0))
    return (rings(t).select("poly", cut.alias("cut")).filter("size(cut) > 0")
            .select("poly", F.size("cut").alias("points"), F.inline(F.array(shapes.bounds(c("cut"))))))


@query("c11_clipped_geometries", "C11", uses="b_points b_polys b_segments", sql="""
    with sq as (select 'Polygon' kind, cast(poly as bigint) id from b_polys group by poly
      having max(e)>2500000 and min(e)<2700000 and max(n)>1100000 and min(n)<1230000),
    pt as (select 'Point' kind, id from b_points where e between 2500000 and 2700000 and n between 1100000 and 1230000),
    d as (select sid, ax, ay, bx-ax dx, b_y-ay dy from b_segments),
    ln as (select 'LineString' kind, sid id from d where
      greatest(0, case when dx>0 then (2500000-ax)/dx when dx<0 then (2700000-ax)/dx else 0 end,
        case when dy>0 then (1100000-ay)/dy when dy<0 then (1230000-ay)/dy else 0 end) <=
      least(1, case when dx>0 then (2700000-ax)/dx when dx<0 then (2500000-ax)/dx else 1 end,
        case when dy>0 then (1230000-ay)/dy when dy<0 then (1100000-ay)/dy else 1 end)
      and not (dx=0 and (ax<2500000 or ax>2700000)) and not (dy=0 and (ay<1100000 or ay>1230000)))
    select kind, id, 1 parts from sq union all select kind, id, 1 from pt union all select kind, id, 1 from ln""")
def _(t):
    part = "array(named_struct('poly', 0, 'ring', 0, 'pts', pts)) parts"
    polys = rings(t).selectExpr("'Polygon' kind", "cast(poly as bigint) id", part)
    points = t.b_points.selectExpr("id", "array(named_struct('e', e, 'n', n)) pts").selectExpr("'Point' kind", "id", part)
    roads = t.b_segments.selectExpr("sid id", "array(named_struct('e', ax, 'n', ay), named_struct('e', bx, 'n', b_y)) pts"
                                    ).selectExpr("'LineString' kind", "id", part)
    both = polys.unionByName(points).unionByName(roads)
    cut = shapes.clip_parts(c("kind"), c("parts"), F.lit(2500000.0), F.lit(1100000.0), F.lit(2700000.0), F.lit(1230000.0))
    return (both.withColumn("cut", cut).filter("size(cut) > 0")
            .select(shapes.clipped_kind(c("kind"), c("cut")).alias("kind"), "id", F.size("cut").alias("parts")))


@query("c12_simplified_tracks", "C12")
def _(t):
    kept = simplify.simplify_points(t.b_tracks, "user_id", 2000.0)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("points"), F.min("i").alias("first"), F.max("i").alias("last"))


@query("c13_closed_rings", "C13", uses="b_polys b_points", sql="""
    select 'ring' kind, cast(poly as bigint) id, 5 points, min(e) min_e, max(e) max_e from b_polys group by poly
    union all select 'circle', id, 65, e-2000, e+2000 from b_points""")
def _(t):
    open_rings = rings(t).select(F.lit("ring").alias("kind"), c("poly").cast("bigint").alias("id"),
                                 shapes.closed(F.slice("pts", 1, 4)).alias("pts"))
    discs = t.b_points.select(F.lit("circle").alias("kind"), "id", shapes.circle(c("e"), c("n"), F.lit(2000.0)).alias("pts"))
    box = shapes.bounds(c("pts"))
    return open_rings.unionByName(discs).select(
        "kind", "id", F.size("pts").alias("points"), F.round(box["min_e"], 3).alias("min_e"), F.round(box["max_e"], 3).alias("max_e"))


@query("c14_segment_distances", "C14", uses="b_points b_segments", sql="""
    with j as (select p.id, p.e, p.n, s.ax, s.ay, s.bx-s.ax dx, s.b_y-s.ay dy from customer
      join b_points p on p.id=c_custkey join supplier on s_nationkey=c_nationkey join b_segments s on s.sid=s_suppkey),
    k as (select *, case when dx*dx+dy*dy=0 then 0 else least(greatest(((e-ax)*dx+(n-ay)*dy)/(dx*dx+dy*dy),0),1) end u from j)
    select id, count(*) n, round(min((e-ax-u*dx)*(e-ax-u*dx)+(n-ay-u*dy)*(n-ay-u*dy)),1) nearest_sq from k group by id""")
def _(t):
    mine = t.customer.select(c("c_custkey").alias("id"), c("c_nationkey").alias("nation")).join(t.b_points, "id")
    theirs = t.supplier.select(c("s_suppkey").alias("sid"), c("s_nationkey").alias("nation")).join(t.b_segments, "sid")
    d = shapes.segment_distance_sq(c("e"), c("n"), c("ax"), c("ay"), c("bx"), c("b_y"))
    return mine.join(theirs, "nation").groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min(d), 1).alias("nearest_sq"))


@query("c15_ascents", "C15 F2", uses="b_tracks", sql="""
    with s as (select user_id, ele-lag(ele) over (partition by user_id order by i) d from b_tracks where ele is not null)
    select user_id, coalesce(sum(greatest(d,0)),0) ascent_m from s group by user_id""")
def _(t):
    return lines.ascents(t.b_tracks, "user_id")


@query("c16_box_algebra", "C16", uses="b_points", sql="""
    with b as (select id%97 grp, e-id%700-500 e0, n-id%700-500 n0, e+id%700+500 e1, n+id%700+500 n1 from b_points)
    select grp, min(e0) min_e, min(n0) min_n, max(e1) max_e, max(n1) max_n, max(e1)-min(e0) width,
      round((max(e1)-min(e0))*(max(n1)-min(n0))/1000000,3) area_km2 from b group by grp""")
def _(t):
    disc = boxes.centred(c("e"), c("n"), (c("id") % 700).cast("double"))
    grown = boxes.grown(disc, F.lit(500.0))
    union = t.b_points.select((c("id") % 97).alias("grp"), grown.alias("b")).groupBy("grp").agg(
        F.min("b.min_e").alias("min_e"), F.min("b.min_n").alias("min_n"),
        F.max("b.max_e").alias("max_e"), F.max("b.max_n").alias("max_n"))
    return union.select("*", (c("max_e") - c("min_e")).alias("width"), F.round(boxes.area_km2(
        F.struct("min_e", "min_n", "max_e", "max_n")), 3).alias("area_km2"))


def area_table(t):
    """Areas of every kind, from the points: three parts per area id."""
    kinds = F.array(*[F.lit(k) for k in ("bbox", "place", "circle", "corridor", "polygon")])
    e, n = c("e"), c("n")
    track = F.array(shapes.point(e, n), shapes.point(e + 3000, n + 1000), shapes.point(e + 4000, n - 2000))
    return t.b_points.select(
        F.floor(c("id") / 3).alias("area_id"), (c("id") % 3).alias("part"),
        F.element_at(kinds, (c("id") % 5 + 1).cast("int")).alias("kind"), "e", "n",
        (1 + c("id") % 4).cast("double").alias("radius_km"), F.lit(0.5).alias("buffer_km"), track.alias("points"),
        (e + 1000).alias("min_e"), n.alias("min_n"), e.alias("max_e"), (n + 500).alias("max_n"))


AREA_SQL = """
    with a as (select id, cast(floor(id/3) as bigint) area_id, id%3 part, id%5 k, e, n, (1+id%4)*1000e0 r from b_points),
    b as (select *, case k when 0 then e when 1 then e-r when 2 then e-r when 3 then e-500 else e end e0,
      case k when 0 then n when 1 then n-r when 2 then n-r when 3 then n-2500 else n-2000 end n0,
      case k when 0 then e+1000 when 1 then e+r when 2 then e+r when 3 then e+4500 else e+4000 end e1,
      case k when 0 then n+500 when 1 then n+r when 2 then n+r when 3 then n+1500 else n+1000 end n1 from a)
"""


@query("c17_area_extents", "C17", uses="b_points", sql=AREA_SQL + """
    select area_id, min(e0) min_e, min(n0) min_n, max(e1) max_e, max(n1) max_n, bool_and(k>=2) masked
    from b group by area_id""")
def _(t):
    return areas.extents(area_table(t))


_ELON, _ELAT = projection.lv95_sql("(7e0+e/1e6)", "(46e0+n/1e6)")


@query("c18_track_imports", "C18", uses="b_tracks", sql=f"""
    with p as (select user_id, i, ele, {_ELON} x, {_ELAT} y from (select user_id, i, ele, e-2600000 e, n-1200000 n from b_tracks) q),
    s as (select *, lag(x) over w px, lag(y) over w py from p window w as (partition by user_id order by i)),
    l as (select user_id, round(coalesce(sum(sqrt((x-px)*(x-px)+(y-py)*(y-py))),0)/1000,3) length_km, count(*) points,
      bool_and(x between 2480000 and 2840000 and y between 1070000 and 1300000) inside from s group by user_id),
    u as (select user_id, greatest(ele-lag(ele) over (partition by user_id order by i),0) d from p where ele is not null)
    select l.user_id, length_km, points, inside, coalesce(a.up,0) ascent_m from l
    left join (select user_id, sum(d) up from u group by user_id) a on l.user_id=a.user_id""")
def _(t):
    raw = t.b_tracks.select("user_id", "i", "ele", (7.0 + (c("e") - 2600000) / 1e6).alias("lon"),
                            (46.0 + (c("n") - 1200000) / 1e6).alias("lat"))
    from terrakit.sources.tracks import import_tracks
    return import_tracks(raw, "user_id").select(
        "user_id", F.round("length_km", 3).alias("length_km"), "points", "inside", "ascent_m")


@query("c18_track_corridors", "C18")
def _(t):
    from terrakit.sources.tracks import simplified_track
    raw = t.b_tracks.select("user_id", "i", "ele", (7.0 + (c("e") - 2600000) / 1e6).alias("lon"),
                            (46.0 + (c("n") - 1200000) / 1e6).alias("lat"))
    return simplified_track(raw, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("points"))


@query("c19_way_references", "C19 F4", uses="b_tracks", sql=f"""
    with p as (select user_id, i, floor(e/4000)*4000 e, floor(n/8000)*8000 n from b_tracks),
    q as (select user_id, i, cast(round({LON}*1e7) as int) x, cast(round({LAT}*1e7) as int) y from p),
    s as (select *, lag(x) over w px, lag(y) over w py from q window w as (partition by user_id order by i)),
    r as (select user_id, count(*) refs from s where px is null or px<>x or py<>y group by user_id)
    select user_id, refs from r where refs>=2""")
def _(t):
    from terrakit.sources.osm import line_references
    coarse = t.b_tracks.select("user_id", "i", (F.floor(c("e") / 4000) * 4000.0).alias("e"),
                               (F.floor(c("n") / 8000) * 8000.0).alias("n"))
    return line_references(coarse, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("refs")).filter("refs >= 2")


@query("c20_emitted_ways", "C20", uses="b_polys b_segments b_points", sql="""
    select 'way' element, 'Polygon' kind, count(distinct poly)+count(distinct case when poly%3=0 then poly end) n from b_polys
    union all select 'way', 'LineString', count(*) from b_segments where ax<>bx or ay<>b_y
    union all select 'poi', 'Point', count(*) from b_points""")
def _(t):
    from terrakit.sources.osm import emit_elements
    p0 = c("pts")[0]
    hole = F.transform(c("pts"), lambda p: shapes.point(p0["e"] + (p["e"] - p0["e"]) / 2, p0["n"] + (p["n"] - p0["n"]) / 2))
    both = rings(t).withColumn("hole", hole).selectExpr(
        "'cover' layer", "cast(poly as bigint) id", "'Polygon' kind",
        """filter(array(named_struct('poly', 0, 'ring', 0, 'pts', pts), named_struct('poly', 0, 'ring', 1, 'pts', hole)),
           x -> x.ring = 0 or poly % 3 = 0) parts""")
    roads = t.b_segments.selectExpr(
        "'roads' layer", "sid id", "'LineString' kind",
        """array(named_struct('poly', 0, 'ring', 0, 'pts', array(named_struct('e', ax, 'n', ay), named_struct('e', bx, 'n', b_y)))) parts""")
    spots = t.b_points.selectExpr(
        "'names' layer", "id", "'Point' kind", "array(named_struct('poly', 0, 'ring', 0, 'pts', array(named_struct('e', e, 'n', n)))) parts")
    made = emit_elements(both.unionByName(roads).unionByName(spots))
    return made.groupBy("element", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("c21_outlines", "C21")
def _(t):
    kept = simplify.simplify_column(rings(t), "pts", 100.0).select("poly", "ring", F.posexplode("pts").alias("i", "p"))
    lon, lat = projection.to_wgs84(c("p.e"), c("p.n"))
    return kept.select("poly", "ring", "i", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("a9_areas_as_geojson", "A9", uses="b_points", sql=AREA_SQL + """
    select area_id, part, k, case when k=2 then 65 when k=4 then 4 else 5 end corners from b""")
def _(t):
    text = areas.to_geojson(area_table(t))
    kinds = F.array(*[F.lit(k) for k in ("bbox", "place", "circle", "corridor", "polygon")])
    parsed = F.from_json("geojson", """properties struct<kind:string>, geometry struct<coordinates:array<array<array<double>>>>""")
    return text.select("area_id", "part", parsed.alias("g")).select(
        "area_id", "part", (F.array_position(kinds, c("g.properties.kind")) - 1).alias("k"),
        F.size(c("g.geometry.coordinates")[0]).alias("corners"))


@query("a9_rings_in_degrees", "A9", uses="b_polys", sql=f"""
    with f as (select poly, 7-i seq, i, printf('%.7f', {LON}) || ' ' || printf('%.7f', {LAT}) pos from b_polys)
    select poly, string_agg(pos, ',' order by i) ring from f group by poly""")
def _(t):
    area = rings(t).select(c("poly").alias("area_id"), F.lit(0).alias("part"), F.lit("polygon").alias("kind"), F.lit(0.0).alias("e"),
                           F.lit(0.0).alias("n"), F.lit(0.0).alias("radius_km"), F.lit(0.0).alias("buffer_km"),
                           F.slice("pts", 1, 4).alias("points"), *[F.lit(0.0).alias(k) for k in ("min_e", "min_n", "max_e", "max_n")])
    parsed = F.from_json("geojson", "geometry struct<coordinates:array<array<array<double>>>>")["geometry"]["coordinates"][0]
    text = F.array_join(F.transform(parsed, lambda p: F.format_string("%.7f %.7f", p[0], p[1])), ",")
    return areas.to_geojson(area).select(c("area_id").alias("poly"), text.alias("ring"))
