"""File formats: each query writes the driver tables in a format with Spark tasks and
reads them back through the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrakit.functions import projection
from terrakit.queries.geometry import rings
from terrakit.registry import query
from terrakit.session import dealt, shared_path

c = F.col
ONE_LINE = "array(named_struct('poly', 0, 'ring', 0, 'pts', array(named_struct('e', ax, 'n', ay), named_struct('e', bx, 'n', b_y))))"
BOX = (2600000.0, 1100000.0, 2750000.0, 1220000.0)
IN_BOX = "greatest(ax,bx)>=2600000 and least(ax,bx)<=2750000 and greatest(ay,b_y)>=1100000 and least(ay,b_y)<=1220000"


def line_features(t):
    return t.b_segments.selectExpr("sid id", "'road ' || sid name", "cast(sid % 7 as string) stufe", "'LineString' kind", f"{ONE_LINE} parts")


@query("a1_geopackage_scan", "A1 B2", uses="b_segments", sql=f"""
    select sid id, 'road ' || sid name, cast(sid%7 as varchar) stufe, ax first_e, b_y last_n from b_segments where {IN_BOX}""")
def _(t):
    from terrakit.sources import encode, gpkg
    folder = shared_path(t.spark, "gpkg")
    encode.write_gpkg(encode.with_blobs(line_features(t)), folder, "roads_2056")
    df = gpkg.read_layer(t.spark, folder, "roads_2056", BOX)
    pts = c("parts")[0]["pts"]
    return df.select("id", "name", "stufe", pts[0]["e"].alias("first_e"), F.element_at(pts, -1)["n"].alias("last_n"))


@query("a1_feature_lake", "A1 B2 E2", uses="b_segments b_points", sql=f"""
    select 'roads' layer, sid id from b_segments where {IN_BOX}
    union all select 'names', id from b_points where e between 2600000 and 2750000 and n between 1100000 and 1220000""")
def _(t):
    from terrakit.sources import lake
    path = shared_path(t.spark, "lake")
    spots = t.b_points.selectExpr("id", "'Point' kind", "array(named_struct('poly', 0, 'ring', 0, 'pts', array(named_struct('e', e, 'n', n)))) parts")
    roads = line_features(t).select("id", "kind", "parts").withColumn("layer", F.lit("roads"))
    lake.write_features(roads.unionByName(spots.withColumn("layer", F.lit("names"))), path)
    return lake.read_features(t.spark, path, ["roads", "names"], BOX).select(c("layer").cast("string").alias("layer"), "id")


@query("a2_geopackage_catalog", "A2", uses="b_segments", sql="""
    select 'roads_2056' "name", 'fid' id_column, 'geom' geometry_column, 2056 srs_id, true has_index, 'fid,geom,name,stufe' "columns", count(*)>0 filled from b_segments""")
def _(t):
    from terrakit.sources import encode, gpkg
    folder = shared_path(t.spark, "gpkg")
    encode.write_gpkg(encode.with_blobs(line_features(t)), folder, "roads_2056")
    return gpkg.read_catalog(t.spark, folder).select(
        "name", "id_column", "geometry_column", "srs_id", "has_index", F.array_join("columns", ",").alias("columns"), F.lit(True).alias("filled")).distinct()


@query("a3_decoded_geometries", "A3", uses="b_points b_polys b_segments", sql="""
    select 'Point' kind, id, 1 points, e first_e, n first_n, null error from b_points where id%10<>0
    union all select null, id, null, null, null, 'no_magic' from b_points where id%10=0
    union all select 'LineString', sid, 2, ax, ay, null from b_segments
    union all select 'Polygon', poly, 5, e, n, null from b_polys where i=0""")
def _(t):
    from terrakit.sources import encode, wkb
    part = "array(named_struct('poly', 0, 'ring', 0, 'pts', pts)) parts"
    points = t.b_points.selectExpr("id", "array(named_struct('e', e, 'n', n)) pts").selectExpr("id", "'Point' kind", part)
    lines = t.b_segments.selectExpr("sid id", "'LineString' kind", f"{ONE_LINE} parts")
    polys = rings(t).selectExpr("cast(poly as bigint) id", "'Polygon' kind", part)
    blobs = encode.with_blobs(lines.unionByName(polys), big=True).withColumn("spot", F.lit(False)).unionByName(
        encode.with_blobs(points).withColumn("spot", F.lit(True)))
    damaged = F.when(c("spot") & (c("id") % 10 == 0), F.encode(F.lit("XX not a blob"), "utf-8")).otherwise(c("geom"))
    good, bad = wkb.good_and_bad(wkb.decode(blobs.withColumn("geom", damaged)))
    first = c("parts")[0]["pts"][0]
    size = F.aggregate("parts", F.lit(0), lambda a, p: a + F.size(p["pts"]))
    return good.select("kind", "id", size.alias("points"), first["e"].alias("first_e"), first["n"].alias("first_n"), F.lit(None).cast("string").alias("error")
                       ).unionByName(bad.select("id", "error"), allowMissingColumns=True)


@query("a4_shapefile_scan", "A4", uses="b_segments", sql=f"""
    select 'LineString' kind, 'road ' || sid name, cast(sid as varchar) nr, ax first_e, b_y last_n from b_segments where {IN_BOX}""")
def _(t):
    from terrakit.sources import encode, shapefile
    folder = shared_path(t.spark, "shp")
    encode.write_shapes(dealt(t.b_segments).selectExpr("'road ' || sid name", "cast(sid as string) nr", "'LineString' kind", f"{ONE_LINE} parts"), folder)
    pts = c("parts")[0]["pts"]
    return shapefile.read_shapes(t.spark, folder, BOX).select(
        "kind", "name", "nr", pts[0]["e"].alias("first_e"), F.element_at(pts, -1)["n"].alias("last_n"))


@query("a5_address_register", "A5 B11", uses="b_addresses", sql="""
    with r as (select *, case when adr_status<>'real' or adr_official<>'true' then 'unofficial'
        when try_cast(adr_easting as double) is null then 'malformed'
        when not (cast(adr_easting as double) between 2500000 and 2750000 and cast(adr_northing as double) between 1080000 and 1250000) then 'outside'
        when adr_number='' then 'malformed' else 'kept' end reason from b_addresses)
    select count(*) scanned, count(*) filter (reason='kept') kept, count(*) filter (reason='unofficial') unofficial,
      count(*) filter (reason='malformed') malformed from r""")
def _(t):
    from terrakit.sources import addresses
    path = shared_path(t.spark, "addresses")
    upper = t.b_addresses.drop("id")
    # The byte-order mark sits on whichever column comes first in the file.
    names = [k.upper() for k in upper.columns]
    upper.toDF(addresses.BOM + names[0], *names[1:]).write.csv(path, sep=";", header=True, quote="", emptyValue="")
    return addresses.stats(addresses.read_addresses(t.spark, path), 2500000.0, 1080000.0, 2750000.0, 1250000.0)


@query("a5_name_register", "A5 B12 F6", uses="b_names", sql="""
    select uuid, trim(name) name from b_names where starts_with(code,'Franz') and trim(name)<>''""")
def _(t):
    from terrakit.sources import addresses, names
    path = shared_path(t.spark, "names")
    # A header line in each file, and the lines as they are: nothing quoted, nothing trimmed.
    t.b_names.select("uuid", "name", "code").toDF(addresses.BOM + "UUID", "NAME", "SPRACHCODE").write.csv(
        path, sep=";", header=True, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = names.read_names(t.spark, path)
    return names.first_names(names.in_language(read, "french"), ["file", "block", "line"]).select(
        c("uuid").cast("bigint").alias("uuid"), "name")


def track_documents(t, size=1000):
    """Track points in documents of at most ``size`` points."""
    lon = 7.0 + (c("e") - 2600000) / 1e6
    lat = 46.0 + (c("n") - 1200000) / 1e6
    return t.b_tracks.select(
        F.concat(c("user_id").cast("string"), F.lit("-"), F.floor((c("i") - 1) / size).cast("string")).alias("path"),
        "i", lon.alias("lon"), lat.alias("lat"), "ele")


TRACK_DOCS = """select user_id || '-' || cast(floor((i-1)/1000) as bigint) path, (i-1)%1000+1 i, 7e0+(e-2600000)/1000000 lon, 46e0+(n-1200000)/1000000 lat, ele from b_tracks"""


@query("a6_gpx_points", "A6", uses="b_tracks", sql=f"""
    select path, i, 1+case when i>500 then 1 else 0 end track, round(lon,7) lon, round(lat,7) lat, ele, 'Tour & ' || path "name" from ({TRACK_DOCS}) d""")
def _(t):
    from terrakit.sources import gpx
    k = (c("i") - 1) % 1000 + 1
    point = F.concat(F.format_string('<g:trkpt lon="%.7f" lat="%.7f">', c("lon"), c("lat")),
                     F.when(c("ele").isNull(), "").otherwise(F.concat(F.lit("<ele>"), c("ele").cast("string"), F.lit("</ele>"))), F.lit("</g:trkpt>"))
    cut = F.when(k == 501, F.lit("</trkseg><trkseg>")).otherwise("")
    docs = track_documents(t).groupBy("path").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("i", F.concat(cut, point).alias("x")))), lambda p: p["x"]), "").alias("body"))
    text = F.concat(F.lit('<?xml version="1.0"?><gpx><wpt lat="46.5" lon="8"><name>hut</name></wpt><trk><name>Tour &amp; '), "path",
                    F.lit("</name><trkseg>"), "body", F.lit("</trkseg></trk></gpx>"))
    return gpx.track_points(docs.select("path", text.alias("text"))).select("path", "i", "track", "lon", "lat", "ele", "name")


@query("a7_fit_points", "A7", uses="b_tracks", sql=f"""
    select path, i, round(round(lon*2147483648e0/180)*180/2147483648e0,7) lon, round(round(lat*2147483648e0/180)*180/2147483648e0,7) lat, ele, path "name" from ({TRACK_DOCS}) d""")
def _(t):
    from terrakit.sources import encode, fit
    docs = track_documents(t).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", "lon", "lat", "ele"))).alias("pts"))
    return fit.decode(encode.fit_files(docs)).select("path", "i", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), "ele", "name")


_E, _N = projection.lv95_sql("lon", "lat")


@query("a8_geojson_areas", "A8", uses="b_points", sql=f"""
    with d as (select id, 6e0+(e-2480000)/90000 lon, 46e0+(n-1070000)/130000 lat from b_points),
    a as (select id, 0 part, lon, lat from d where id%3<>2 union all select id, 1, lon+0.5e0, lat from d where id%3=1)
    select id, part, 3 corners, round({_E},3) e, round({_N},3) n from a""")
def _(t):
    from terrakit.sources import geojson
    d = t.b_points.select("id", (6.0 + (c("e") - 2480000) / 90000).alias("lon"), (46.0 + (c("n") - 1070000) / 130000).alias("lat"))

    def ring(shift):
        spots = [(0.0, 0.0), (0.01, 0.0), (0.0, 0.01), (0.0, 0.0)]
        return F.concat(F.lit("["), F.concat_ws(",", *[F.concat(
            F.lit("["), (c("lon") + shift + x).cast("string"), F.lit(","), (c("lat") + y).cast("string"), F.lit("]")) for x, y in spots]), F.lit("]"))

    dot = '{"type":"Feature","geometry":{"type":"Point","coordinates":[8.1,46.9]}}'
    one = F.concat(F.lit('{"type":"FeatureCollection","features":[' + dot + ',{"type":"Feature","geometry":{"type":"Polygon","coordinates":['), ring(0.0), F.lit("]}}]}"))
    two = F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"MultiPolygon","coordinates":[['), ring(0.0), F.lit("],["), ring(0.5), F.lit("]]}]}"))
    docs = d.select(c("id").cast("string").alias("path"), F.when(c("id") % 3 == 0, one).when(c("id") % 3 == 1, two).otherwise(F.lit(dot)).alias("text"))
    p = geojson.polygons(docs)
    return p.select(c("path").cast("bigint").alias("id"), "part", F.size("points").alias("corners"),
                    F.round(c("points")[0]["e"], 3).alias("e"), F.round(c("points")[0]["n"], 3).alias("n"))


@query("a10_catalogue_assets", "A10 B25", uses="b_assets", sql="""
    select item page, 'item-' || item id, name, 'https://data/' || name href, case when item%4=0 then sha256(name) end digest from b_assets where item%5<>0""")
def _(t):
    from terrakit.sources import catalogue
    mark = F.when(c("item") % 4 == 0, F.concat(F.lit(',"file:checksum":"1220'), F.sha2("name", 256), F.lit('"')))
    mark = F.coalesce(mark, F.lit(',"file:checksum":"broken"'))
    href = F.when(c("item") % 5 == 0, "").otherwise(F.concat(F.lit('"href":"https://data/'), "name", F.lit('",')))
    text = F.concat(
        F.lit('{"features":[17,{"id":"item-'), c("item").cast("string"), F.lit('","properties":{"datetime":"2020-01-01T00:00:00Z"},"assets":{"'),
        "name", F.lit('":{'), href, F.lit('"type":"image/tiff"'), mark, F.lit('}}}],"links":[]}'))
    return catalogue.assets(t.b_assets.select(c("item").alias("page"), text.alias("text"))).select("page", "id", "name", "href", "digest")


def sample_lines(t):
    good = F.concat(
        F.lit('{"predictors":{"groupCounts":{"transport":'), c("transport").cast("string"), F.lit(',"built":'), c("built").cast("string"),
        F.lit('},"areaKm2":'), c("area_km2").cast("string"), F.lit(',"contourIntervalM":20,"relief":"off"},"actualBytes":'),
        c("actual_bytes").cast("string"), F.lit(',"stageSeconds":[["extract",1.5],["compile",2]]}'))
    return t.b_samples.select(F.when(c("id") % 9 == 0, F.substring(good, 1, 40)).when(c("id") % 10 == 0, "").otherwise(good).alias("line"))


@query("a11_calibration_lines", "A11", uses="b_samples", sql="""
    select transport, built, area_km2, contour_interval_m, actual_bytes, false wrist, 3.5e0 as seconds from (select *, 20 contour_interval_m from b_samples) s
    where id%9<>0 and id%10<>0""")
def _(t):
    from terrakit.sources import records
    total = F.aggregate("stages", F.lit(0.0), lambda a, x: a + x["seconds"])
    return records.samples(sample_lines(t)).select(
        "transport", "built", "area_km2", "contour_interval_m", "actual_bytes", "wrist", total.alias("seconds"))


@query("a14_relief_table", "A14 J7", uses="b_grid", sql="""
    select lat, lon, 3721 samples from (values (46,7),(46,8),(47,7)) v(lat,lon)""")
def _(t):
    from terrakit.queries.terrain import relief
    path = shared_path(t.spark, "relief")
    relief(t).write.partitionBy("lat", "lon").parquet(path)
    return t.spark.read.parquet(path).groupBy("lat", "lon").agg(F.count("h").alias("samples"))


@query("a15_run_manifests", "A15 E6", uses="b_assets", sql="""
    with s as (select cell, count(*) releases, cast(sum(bytes) as bigint) bytes from (select cell, yr, sum(item) bytes from b_assets group by 1,2) q group by 1),
    l as (select o_custkey cell, count(*) features, count(distinct o_orderstatus) layers from orders group by 1)
    select c_custkey run, coalesce(releases,0) releases, coalesce(bytes,0) bytes, coalesce(features,0) features, coalesce(layers,0) layers
    from customer left join s on s.cell=c_custkey left join l on l.cell=c_custkey""")
def _(t):
    from terrakit.sources import manifest
    path = shared_path(t.spark, "manifests")
    runs = t.customer.select(c("c_custkey").alias("run"), c("c_name").alias("recipe"))
    sources = t.b_assets.groupBy(c("cell").alias("run"), c("yr").cast("string").alias("collection")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("item").alias("bytes")).withColumn("item", F.lit("x"))
    layers = t.orders.groupBy(c("o_custkey").alias("run"), c("o_orderstatus").alias("layer")).agg(F.count(F.lit(1)).alias("n"))
    stages = t.orders.groupBy(c("o_custkey").alias("run")).agg(F.lit("extract").alias("stage"), F.lit(1.0).alias("seconds"))
    manifest.append_manifests(manifest.manifests(runs, sources, layers, stages), path)
    back = t.spark.read.schema("run bigint, " + manifest.MANIFEST_SCHEMA).json(path)
    zero = F.lit(0).cast("bigint")
    return back.select(
        "run", F.size(F.coalesce("sources", F.array().cast("array<struct<collection:string,item:string,files:bigint,bytes:bigint>>"))).alias("releases"),
        F.coalesce(F.aggregate("sources", zero, lambda a, x: a + x["bytes"]), zero).alias("bytes"),
        F.coalesce(F.aggregate(F.map_values("features_per_layer"), zero, lambda a, x: a + x), zero).alias("features"),
        F.coalesce(F.size(F.map_keys("features_per_layer")), F.lit(0)).alias("layers"))
