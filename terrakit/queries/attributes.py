"""Projections, filters, predicates and attribute cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrakit.functions import attrs, projection
from terrakit.plans import layers
from terrakit.registry import query

FOLD_SQL = f"translate(replace(lower(trim(%s)),'ß','ss'),'{attrs.FOLD_FROM}','{attrs.FOLD_TO}')"


@query("b1_wanted_columns", "B1", uses="b_features",
       sql="select id, layer, objektart, name from b_features")
def _(t):
    wanted = ["id", "layer", "objektart", "name", "belagsart", "verlauf"]
    return layers.select_available(t.b_features, wanted)


@query("b2_segment_boxes_in_box", "B2", uses="b_segments", sql="""
    select sid from b_segments
    where greatest(ax,bx)>=2600000 and least(ax,bx)<=2700000
      and greatest(ay,b_y)>=1150000 and least(ay,b_y)<=1230000""")
def _(t):
    from terrakit.functions.boxes import box_meets
    s = t.b_segments
    return s.filter(
        box_meets(F.least("ax", "bx"), F.least("ay", "b_y"), F.greatest("ax", "bx"),
                  F.greatest("ay", "b_y"), 2600000.0, 1150000.0, 2700000.0, 1230000.0)
    ).select("sid")


@query("b3_points_in_box", "B3", uses="b_points", sql="""
    select id, e, n from b_points where e between 2600000 and 2700000 and n between 1150000 and 1250000""")
def _(t):
    from terrakit.functions.boxes import box_has
    return t.b_points.filter(box_has(F.col("e"), F.col("n"), 2600000.0, 1150000.0, 2700000.0, 1250000.0))


@query("b4_no_data_to_null", "B4", uses="b_features", sql="""
    select layer, case when objektart in ('','k_W','Keine Angabe') then null else objektart end objektart,
           count(*) n from b_features group by 1,2""")
def _(t):
    return (t.b_features.withColumn("objektart", attrs.meaningful(F.col("objektart")))
            .groupBy("layer", "objektart").agg(F.count(F.lit(1)).alias("n")))


@query("b5_number_tags", "B5", uses="b_features", sql="""
    select id, case when width/4=floor(width/4) then cast(cast(width/4 as bigint) as varchar)
                    else cast(width/4 as varchar) end width_tag,
           cast(access as varchar) access_tag from b_features""")
def _(t):
    return t.b_features.select(
        "id", attrs.number_tag(F.col("width") / 4).alias("width_tag"),
        F.col("access").cast("string").alias("access_tag"))


@query("b6_resolve_layer_names", "B6", uses="b_features", sql="""
    with specs(spec) as (values ('roads'),('cov'),('names_2056'),('na')),
    have as (select distinct layer || case when layer='roads' then '' else '_2056' end layer from b_features)
    select spec, (select min(layer) from have where layer=spec or
                  (starts_with(layer,spec) and not exists (select 1 from have h where h.layer=spec))) layer
    from specs""")
def _(t):
    have = t.b_features.select("layer").distinct().select(
        F.when(F.col("layer") == "roads", F.col("layer"))
        .otherwise(F.concat("layer", F.lit("_2056"))).alias("layer"))
    specs = t.values("values ('roads'),('cov'),('names_2056'),('na') as v(spec)")
    return layers.resolve_layers(specs, have)


@query("b7_tag_maps", "B7", uses="b_features", sql="""
    select id, 'tlm:layer=' || layer
      || case when objektart in ('','k_W','Keine Angabe') then '' else ';tlm:objektart=' || objektart end
      || ';tlm:access=' || cast(access as varchar) tags from b_features""")
def _(t):
    made = attrs.tags("tlm", F.col("layer"), {
        "objektart": attrs.meaningful(F.col("objektart")),
        "access": F.col("access").cast("string")})
    text = F.array_join(F.transform(F.map_entries(made), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return t.b_features.select("id", text.alias("tags"))


@query("b8_name_variants", "B8", uses="b_features", sql="""
    with p as (select id, list_filter([trim(x) for x in string_split(name,'|')], lambda s: s<>'') v, name
               from b_features)
    select id, coalesce(v[1], name) label,
           case when len(v)>1 then array_to_string(v[2:], ';') end alt_name from p""")
def _(t):
    return t.b_features.select(
        "id", attrs.primary_name(F.col("name")).alias("label"),
        attrs.other_names(F.col("name")).alias("alt_name"))


@query("b9_folded_names", "B9", uses="b_names",
       sql=f"select uuid, {FOLD_SQL % 'name'} folded from b_names")
def _(t):
    return t.b_names.select("uuid", attrs.fold(F.col("name")).alias("folded"))


@query("b10_postcodes", "B10", uses="b_addresses", sql="""
    select id, regexp_extract(zip_label,'^([0-9]+) (.*)$',1) postcode,
      case when regexp_matches(zip_label,'^([0-9]+) (.*)$')
           then trim(regexp_extract(zip_label,'^([0-9]+) (.*)$',2)) else zip_label end locality
    from b_addresses""")
def _(t):
    z = F.col("zip_label")
    return t.b_addresses.select("id", attrs.postcode(z).alias("postcode"), attrs.locality(z).alias("locality"))


ADDRESS_SQL = """
    with r as (select *, case when adr_status<>'real' then 'unofficial'
        when adr_official<>'true' then 'unofficial'
        when try_cast(adr_easting as double) is null or try_cast(adr_northing as double) is null then 'malformed'
        when not (try_cast(adr_easting as double) between 2500000 and 2750000
              and try_cast(adr_northing as double) between 1080000 and 1250000) then 'outside'
        when stn_label='' or adr_number='' then 'malformed' else 'kept' end reason from b_addresses)
"""


@query("b11_address_reasons", "B11 A5", uses="b_addresses",
       sql=ADDRESS_SQL + " select reason, count(*) n from r group by reason")
def _(t):
    from terrakit.sources.addresses import with_reason
    return (with_reason(t.b_addresses, 2500000.0, 1080000.0, 2750000.0, 1250000.0)
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


@query("b11_kept_addresses", "B11", uses="b_addresses", sql=ADDRESS_SQL + """
    select id, stn_label street, adr_number number, cast(adr_easting as double) e,
           cast(adr_northing as double) n from r where reason='kept'""")
def _(t):
    from terrakit.sources.addresses import kept
    return kept(t.b_addresses, 2500000.0, 1080000.0, 2750000.0, 1250000.0).select(
        "id", "street", "number", "e", "n")


@query("b12_language_filter", "B12", uses="b_names", sql="""
    select uuid, name from b_names where starts_with(code,'Franz') and trim(name)<>''""")
def _(t):
    from terrakit.sources.names import in_language
    return in_language(t.b_names, "french").select("uuid", "name")


@query("b13_layers_kept", "B13", uses="b_features", sql="""
    with specs(layer, needs) as (values ('roads','base'),('cover','base'),('names','winter')),
    off(layer) as (values ('cover')), presets(preset, winter) as (values ('hiking',false),('skimo',true))
    select preset, f.layer, count(*) n from b_features f join specs s on f.layer=s.layer
    join presets p on s.needs='base' or p.winter
    where f.layer not in (select layer from off) group by 1,2""")
def _(t):
    specs = t.values("values ('roads','base'),('cover','base'),('names','winter') as v(layer, needs)")
    off = t.values("values ('cover') as v(layer)")
    counts = t.b_features.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    return layers.gate(counts.join(specs, "layer"), off, ["hiking", "skimo"]).select("preset", "layer", "n")


@query("b14_dataset_keys", "B14", uses="b_assets", sql="""
    select distinct lower(regexp_replace(regexp_replace(name,'_2_2056_5728.tif$',''),'_[0-9]*$','')) k
    from (select 'Ski_Routes_' || cast(yr as varchar) name from b_assets)""")
def _(t):
    stem = F.concat(F.lit("Ski_Routes_"), F.col("yr").cast("string"))
    return t.b_assets.select(attrs.dataset_key(stem).alias("k")).distinct()


@query("b15_tile_names", "B15", uses="b_assets", sql="""
    select item, cast(split_part(name,'_',2) as int) yr,
           cast(split_part(split_part(name,'_',3),'-',1) as int) e_km,
           cast(split_part(split_part(name,'_',3),'-',2) as int) n_km from b_assets""")
def _(t):
    name = F.col("name")
    return t.b_assets.select("item", attrs.tile_year(name).alias("yr"),
                             attrs.tile_e_km(name).alias("e_km"), attrs.tile_n_km(name).alias("n_km"))


@query("b16_contour_tiers", "B16", uses="b_grid", sql="""
    with cfg(interval_m, major_m, medium_m) as (values (20,100,0),(20,100,50),(10,100,50)),
    lv as (select distinct cast(floor(z) as int) ele from b_grid where z>-9999)
    select interval_m, major_m, medium_m, ele,
      case when major_m>0 and ele%major_m=0 then 'elevation_major'
           when medium_m>0 and ele%medium_m=0 then 'elevation_medium' else 'elevation_minor' end tier,
      medium_m<=0 or exists(select 1 from range(1,1001) k(k) where (k*interval_m)%nullif(medium_m,0)=0
            and (major_m<=0 or (k*interval_m)%major_m<>0)) reachable
    from lv cross join cfg""")
def _(t):
    from terrakit.functions.relief import medium_reachable, tier
    levels = t.b_grid.filter("z > -9999").select(F.floor("z").cast("int").alias("ele")).distinct()
    settings = F.array(*[F.struct(F.lit(a).alias("interval_m"), F.lit(b).alias("major_m"), F.lit(c).alias("medium_m"))
                         for a, b, c in [(20, 100, 0), (20, 100, 50), (10, 100, 50)]])
    rows = levels.select("ele", F.inline(settings))
    c = F.col
    return rows.select("interval_m", "major_m", "medium_m", "ele",
                       tier(c("ele"), c("major_m"), c("medium_m")).alias("tier"),
                       medium_reachable(c("interval_m"), c("major_m"), c("medium_m")).alias("reachable"))


@query("b22_effective_limits", "B22", uses="", sql="""
    with p as (select s_suppkey id, cast(floor(abs(s_acctbal)*1000) as bigint) budget,
      case s_nationkey%4 when 0 then 'vendor' when 1 then 'measured' when 2 then 'community' else 'assumed' end level
      from supplier),
    o as (select s_suppkey id, cast(5000000 as bigint) budget from supplier where s_suppkey%10=0)
    select p.id, case when o.id is not null then 'measured' else level end level,
      cast(floor(coalesce(o.budget,p.budget) * case when o.id is not null then 1e0
        when level in ('vendor','measured') then 1e0 when level='community' then 0.8e0 else 0.7e0 end) as bigint) budget
    from p left join o on p.id=o.id""")
def _(t):
    from terrakit.plans.devices import effective_limits
    level = F.element_at(F.array(*[F.lit(x) for x in ("vendor", "measured", "community", "assumed")]),
                         (F.col("s_nationkey") % 4 + 1).cast("int"))
    profiles = t.supplier.select(F.col("s_suppkey").alias("id"),
                                 F.floor(F.abs("s_acctbal") * 1000).cast("bigint").alias("budget"), level.alias("level"))
    overrides = t.supplier.filter("s_suppkey % 10 = 0").select(
        F.col("s_suppkey").alias("id"), F.lit(5000000).cast("bigint").alias("budget"))
    return effective_limits(profiles, overrides, ["budget"])


@query("b23_safe_names", "B23", sql="""
    select p_partkey id, 'gmapsupp-' || regexp_replace(regexp_replace(p_name || ' #' || p_type || '!','[^A-Za-z0-9]','-','g'),
       '^-+|-+$','','g') || '.img' file from part""")
def _(t):
    name = F.concat("p_name", F.lit(" #"), "p_type", F.lit("!"))
    return t.part.select(F.col("p_partkey").alias("id"),
                         attrs.image_file_name(name, F.lit(False), F.lit(True)).alias("file"))


_LON, _LAT = projection.wgs84_sql("e", "n")


@query("b24_tile_requests", "B24", uses="b_points", sql=f"""
    with d as (select id, {_LON} lon, {_LAT} lat from b_points)
    select id, 'https://wms.geo.admin.ch/?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS=ch.swisstopo.pixelkarte-farbe'
      || '&STYLES=&CRS=EPSG:4326&BBOX=' || printf('%.8f,%.8f,%.8f,%.8f', lat, lon, lat+0.01e0, lon+0.01e0)
      || '&WIDTH=1024&HEIGHT=512&FORMAT=image/jpeg' url from d""")
def _(t):
    lon, lat = projection.to_wgs84(F.col("e"), F.col("n"))
    return t.b_points.select("id", lon.alias("lon"), lat.alias("lat")).select(
        "id", attrs.tile_request("ch.swisstopo.pixelkarte-farbe", F.col("lon"), F.col("lat"),
                                 F.col("lon") + 0.01, F.col("lat") + 0.01, F.lit(1024), F.lit(512)).alias("url"))


@query("b25_checksums", "B25", sql="""
    with h as (select doc_id, sha256(text) digest, case doc_id%5 when 0 then '1220' || sha256(text)
        when 1 then '1120' || sha256(text) when 2 then '1221' || sha256(text) when 3 then 'zz' || sha256(text)
        else '1' end mh from documents)
    select doc_id, case when not regexp_full_match(lower(mh),'([0-9a-f]{2})*') then 'not hex'
        when substr(mh,1,2)<>'12' then 'unsupported code' when substr(mh,3,2)<>'20' then 'wrong length' end reason,
      case when doc_id%5=0 then digest end digest from h""")
def _(t):
    digest = F.sha2(F.col("text"), 256)
    k = F.col("doc_id") % 5
    mh = (F.when(k == 0, F.concat(F.lit("1220"), digest)).when(k == 1, F.concat(F.lit("1120"), digest))
          .when(k == 2, F.concat(F.lit("1221"), digest)).when(k == 3, F.concat(F.lit("zz"), digest)).otherwise("1"))
    # The digest is hashed once per row and shared by both outputs.
    return t.documents.select("doc_id", mh.alias("mh")).select(
        "doc_id", attrs.multihash_reason(F.col("mh")).alias("reason"), attrs.multihash_digest(F.col("mh")).alias("digest"))


@query("b26_map_identities", "B26", sql="""
    with recursive k as (select c_custkey id, c_name || '|' || c_mktsegment txt from customer),
    f(id, txt, i, h) as (
      select id, txt, 0, cast(2166136261 as bigint) from k
      union all
      select id, txt, i+1, (xor(h, cast(ascii(substr(txt,i+1,1)) as bigint)) * 16777619) & 4294967295 from f where i<length(txt))
    select id, h fnv, 6000 + h%55000 family,
      10000000 + ((((h << 13) & 4294967295) | (h >> 19)) % 8900)*10000 map_base from f where i=length(txt)""")
def _(t):
    key = F.concat("c_name", F.lit("|"), "c_mktsegment")
    return t.customer.select(F.col("c_custkey").alias("id"), attrs.fnv32(key).alias("fnv"),
                             attrs.map_family(key).alias("family"), attrs.map_number_base(key).alias("map_base"))


@query("b27_cell_labels", "B27", uses="b_points", sql=f"""
    with d as (select id, cast(floor(e/1000) as int) ek, cast(floor(n/1000) as int) nk,
       cast(floor({_LAT}) as int) la, cast(floor({_LON}) as int) lo from b_points)
    select id, cast(ek as varchar) || '-' || cast(nk as varchar) km_cell,
       printf('N%02dE%03d', la, lo) degree_cell from d""")
def _(t):
    lon, lat = projection.to_wgs84(F.col("e"), F.col("n"))
    return t.b_points.select(
        "id", attrs.cell_label(F.floor(F.col("e") / 1000), F.floor(F.col("n") / 1000)).alias("km_cell"),
        attrs.degree_label(F.floor(lat).cast("int"), F.floor(lon).cast("int")).alias("degree_cell"))


@query("b28_coverage", "B28", uses="b_tracks b_polys", sql="""
    select 'track' kind, user_id id, bool_and(e between 2480000 and 2840000 and n between 1070000 and 1300000) inside
    from b_tracks group by user_id
    union all select 'poly', poly, max(e)>=2480000 and min(e)<=2840000 and max(n)>=1070000 and min(n)<=1300000
    from b_polys group by poly""")
def _(t):
    from terrakit.functions.boxes import box_has, box_meets
    b = projection.BOUNDS
    tracks = t.b_tracks.groupBy("user_id").agg(
        F.bool_and(box_has(F.col("e"), F.col("n"), *b)).alias("inside")
    ).select(F.lit("track").alias("kind"), F.col("user_id").alias("id"), "inside")
    polys = t.b_polys.groupBy("poly").agg(
        F.min("e").alias("e0"), F.min("n").alias("n0"), F.max("e").alias("e1"), F.max("n").alias("n1")
    ).select(F.lit("poly").alias("kind"), F.col("poly").cast("bigint").alias("id"),
             box_meets(F.col("e0"), F.col("n0"), F.col("e1"), F.col("n1"), *b).alias("inside"))
    return tracks.unionByName(polys)


@query("b29_tinted_pixels", "B29", uses="b_pixels", sql="""
    select spot, count(*) tinted from b_pixels
    where not (greatest(cr,cg,cb)>246 and least(cr,cg,cb)>240) and greatest(cr,cg,cb)>=60
      and not (abs(cr-cg)<4 and abs(cg-cb)<4 and abs(cr-cb)<4) group by spot""")
def _(t):
    return (t.b_pixels.filter(attrs.tinted(F.col("cr"), F.col("cg"), F.col("cb")))
            .groupBy("spot").agg(F.count(F.lit(1)).alias("tinted")))


@query("b30_rfc3339", "B30", sql="""
    select event_id, strftime(ts,'%Y-%m-%dT%H:%M:%SZ') stamp from events""")
def _(t):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", attrs.rfc3339(seconds).alias("stamp"))
