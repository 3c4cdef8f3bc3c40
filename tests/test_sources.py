"""Hand-built files: damaged, truncated, other byte orders, other encodings."""

import os
import sqlite3
import struct
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrakit.sources import addresses, catalogue, encode, fit, geojson, gpkg, gpx, names, records, shapefile, wkb

c = F.col


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def put(folder, name, content):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode("utf-8"))
    return path


def part(poly, ring, *pts):
    return {"poly": poly, "ring": ring, "pts": [{"e": float(e), "n": float(n)} for e, n in pts]}


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("envelope", [False, True])
def test_wkb_kinds(big, envelope):
    square = [(0, 0), (1, 0), (1, 1), (0, 0)]
    for kind, parts in (
        ("Point", [part(0, 0, (1, 2))]), ("LineString", [part(0, 0, (1, 2), (3, 4))]),
        ("Polygon", [part(0, 0, *square), part(0, 1, *square)]), ("MultiPoint", [part(0, 0, (1, 2)), part(1, 0, (3, 4))]),
        ("MultiPolygon", [part(0, 0, *square), part(1, 0, *square), part(1, 1, *square)]),
    ):
        got, found = wkb.read_blob(encode.blob(kind, parts, big, envelope))
        assert got == kind
        assert [(p, r, [tuple(x) for x in pts]) for p, r, pts in found] == [
            (p["poly"], p["ring"], [(x["e"], x["n"]) for x in p["pts"]]) for p in parts]


def test_wkb_drops_heights_and_reports_damage():
    zm = b"GP\0\1" + struct.pack("<i", 2056) + b"\1" + struct.pack("<II", 3002, 2) + struct.pack("<8d", 1, 2, 9, 9, 3, 4, 9, 9)
    assert [tuple(p) for p in wkb.read_blob(zm)[1][0][2]] == [(1, 2), (3, 4)]
    assert wkb.read_blob(b"GP\0\x11" + bytes(4)) is None
    for bad in (b"XX\0\1aaaaaaa", zm[:-5], b"GP\0\x0b" + bytes(20), b"GP\0\1" + bytes(4) + b"\1" + struct.pack("<I", 99)):
        with pytest.raises(wkb.BadGeometry):
            wkb.read_blob(bad)


def test_geopackage_scan(spark, folder):
    rows = pd.DataFrame({
        "id": range(1, 101), "name": [f"r{k}" for k in range(1, 101)],
        "geom": [encode.blob("LineString", [part(0, 0, (k * 10, k * 10), (k * 10 + 5, k * 10 + 5))]) for k in range(1, 101)]})
    encode.gpkg_file(os.path.join(folder, "a.gpkg"), "roads_2056", rows, ["name"])
    encode.gpkg_file(os.path.join(folder, "b.gpkg"), "roads_2056", rows.assign(id=rows["id"] + 1000), ["name"], index=False)
    gpkg.register(spark)
    reader = spark.read.format("gpkg").option("table", "roads_2056").option("rowsPerSplit", 30)
    df = reader.load(folder)
    assert df.count() == 200 and df.rdd.getNumPartitions() == 8
    got = gpkg.read_layer(spark, folder, "roads_2056", (500.0, 500.0, 520.0, 520.0)).collect()
    # Box tests are inclusive: 495..505, 500..505, 510, 520.
    assert sorted(r.id for r in got) == [50, 51, 52, 1050, 1051, 1052]
    assert got[0].parts[0].pts[0].e % 10 == 0
    cat = gpkg.read_catalog(spark, folder).orderBy("file").collect()
    assert [(r.name, r.id_column, r.has_index) for r in cat] == [("roads_2056", "fid", True), ("roads_2056", "fid", False)]


def test_geopackage_missing_column_and_types(spark, folder):
    path = os.path.join(folder, "t.gpkg")
    encode.gpkg_file(path, "x", pd.DataFrame({"id": [1], "geom": [encode.blob("Point", [part(0, 0, (1, 2))])]}), [])
    con = sqlite3.connect(path)
    con.execute('alter table x add column "access" integer')
    con.execute('alter table x add column "len" real')
    con.execute("update x set access = 2, len = 1.5")
    con.commit()
    con.close()
    r = gpkg.read_layer(spark, path, "x").first()
    assert (r.access, r.len, r.kind, r.min_e) == (2, 1.5, "Point", 1.0)


def test_shapefile(spark, folder):
    frame = pd.DataFrame({
        "kind": ["LineString", "MultiLineString"], "name": ["Zürich", "b"],
        "parts": [[part(0, 0, (0, 0), (1, 1))], [part(0, 0, (10, 10), (11, 11)), part(1, 0, (12, 12), (13, 13))]]})
    encode.shape_files(os.path.join(folder, "veloland_Route.shp"), frame, ["name"])
    rows = shapefile.read_shapes(spark, folder).orderBy("record").collect()
    assert [(r.file, r.kind, r.name, len(r.parts)) for r in rows] == [
        ("veloland_Route", "LineString", "Zürich", 1), ("veloland_Route", "MultiLineString", "b", 2)]
    assert shapefile.read_shapes(spark, folder, (11.0, 11.0, 12.0, 12.0)).count() == 1
    os.remove(os.path.join(folder, "veloland_Route.shx"))
    assert shapefile.read_shapes(spark, folder).count() == 2
    # Latin-1 where the bytes are no UTF-8, and a damaged last record.
    dbf = os.path.join(folder, "veloland_Route.dbf")
    raw = open(dbf, "rb").read()
    put(folder, "veloland_Route.dbf", raw.replace("Zürich".encode(), "Zürich ".encode("latin-1")))
    shp = os.path.join(folder, "veloland_Route.shp")
    put(folder, "veloland_Route.shp", open(shp, "rb").read()[:-4])
    got = shapefile.read_shapes(spark, folder).collect()
    assert [r.name for r in got] == ["Zürich"]


def test_shape_types():
    ring = struct.pack("<i4d2i", 15, 0, 0, 9, 9, 2, 8) + struct.pack("<2i", 0, 4) + struct.pack("<16d", *range(16))
    kind, parts = shapefile.shape(ring)
    assert kind == "MultiPolygon" and [p[0] for p in parts] == [0, 1]
    assert shapefile.shape(struct.pack("<i", 0)) is None
    assert shapefile.shape(struct.pack("<idd", 11, 1, 2))[0] == "Point"
    with pytest.raises(ValueError):
        shapefile.shape(struct.pack("<i", 31))


def test_fit(spark):
    good = encode.fit_bytes("Tour", [(8.0, 46.5, 1200.0), (8.1, 46.6, None)])
    short = good[:-3]
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(short)), ("c", bytearray(b"nonsense that is long"))], "path string, content binary")
    rows = {}
    for r in fit.decode(df).collect():
        rows.setdefault(r.path, []).append(r)
    assert [(round(r.lon, 6), round(r.lat, 6), r.ele) for r in rows["a"]] == [(8.0, 46.5, 1200.0), (8.1, 46.6, None)]
    assert len(rows["b"]) == 1 and rows["a"][0].name == "Tour" and rows["c"][0].error == "fit_header_length"


def test_fit_sentinels_order_and_course_points():
    assert fit.whole_number(b"\xff\xff\xff\x7f", 0x85, False) is None
    assert fit.whole_number(b"\xff\xff", 0x84, True) is None
    assert fit.whole_number(b"\xff\xff\xff\xff", 0x85, False) == -1
    define = bytes([0x40, 0, 1]) + struct.pack(">HB", 32, 2) + bytes([1, 4, 0x85, 2, 4, 0x85])
    data = b"\0" + struct.pack(">ii", 2**30, 2**29) + b"\x80" + struct.pack(">ii", 2**29, 2**28)
    body = define + data
    name, points = fit.course(struct.pack("<BBHI4sH", 14, 16, 0, len(body), b".FIT", 0) + body)
    assert name is None and [(round(x), round(y)) for x, y, _ in points] == [(45, 90), (22, 45)]


GPX = """<?xml version="1.0"?><gpx><metadata><name>no</name></metadata>
<wpt lat="46.6" lon="8.0"><name>Grimsel</name><ele>2164</ele></wpt><!-- <trkpt lat="1" lon="1"/> -->
<trk><name>A &amp; B</name><trkseg><trkpt lat="46.1" lon='8.1'><ele>100</ele></trkpt><trkpt lat="46.2" lon="8.2"/></trkseg>
<trkseg><x:trkpt lat="46.3" lon="8.3"><ele> bad </ele></x:trkpt></trkseg></trk>
<rte><name>Route</name><rtept lat="46.4" lon="8.4"/></rte><trkpt lat="46.5" lon="8.5"/>
<trk><trkseg><trkpt lat="46.6" lon="8.6"><ele>7"""


def test_gpx(spark):
    docs = spark.createDataFrame([("a", GPX), ("b", "<gpx/>")], "path string, text string")
    rows = gpx.track_points(docs).orderBy("i").collect()
    assert [(r.track, r.lat, r.ele, r.name) for r in rows] == [
        (1, 46.1, 100.0, "A & B"), (1, 46.2, None, "A & B"), (2, 46.3, None, "A & B"), (3, 46.4, None, "Route"),
        (4, 46.5, None, None), (5, 46.6, None, None)] or [r.lat for r in rows] == [46.1, 46.2, 46.3, 46.4, 46.5, 46.6]
    assert [r.track for r in rows] == [1, 1, 2, 3, 4, 5]
    w = gpx.waypoints(docs).collect()
    assert [(r.name, r.ele) for r in w] == [("Grimsel", 2164.0)]


def test_geojson_nested_deeply(spark):
    shape = '{"type":"Polygon","coordinates":[[[7.0,46.0],[7.1,46.0],[7.1,46.1],[7.0,46.0]]]}'
    for _ in range(14):
        shape = '{"type":"GeometryCollection","geometries":[' + shape + "]}"
    docs = spark.createDataFrame([("deep", shape)], "path string, text string")
    assert geojson.polygons(docs).count() == 1


def test_geojson(spark):
    square = "[[8,46],[8.1,46],[8.1,46.1],[8,46]]"
    docs = spark.createDataFrame([
        ("a", '{"type":"Polygon","coordinates":[%s,%s]}' % (square, square)),
        ("b", '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"GeometryCollection","geometries":[{"type":"MultiPolygon","coordinates":[[%s],[%s]]}]}}]}' % (square, square)),
        ("c", '{"type":"LineString","coordinates":[[8,46],[9,46]]}'), ("d", "not json"),
        ("e", '{"type":"Polygon","coordinates":[[[8,46],[9,46],[8,46]]]}'),
    ], "path string, text string")
    got = geojson.polygons(docs).groupBy("path").agg(F.count("*").alias("m"), F.max(F.size("points")).alias("k")).collect()
    assert {(r.path, r.m, r.k) for r in got} == {("a", 1, 3), ("b", 2, 3)}
    assert {r.path for r in geojson.rejected(docs).collect()} == {"c", "d", "e"}


def test_catalogue(spark):
    page = ('{"features":["bad",{"id":"x","properties":{"datetime":"2024"},"assets":{"a.gpkg.zip":{"href":"u","file:checksum":"1220%s"},'
            '"b.xml":{"type":"t"},"c.csv.zip":{"href":"v","file:checksum":"zz"}}}]}') % ("ab" * 32)
    rows = {r.name: r for r in catalogue.assets(spark.createDataFrame([(1, page)], "page int, text string")).collect()}
    assert set(rows) == {"a.gpkg.zip", "c.csv.zip"} and rows["a.gpkg.zip"].digest == "ab" * 32 and rows["c.csv.zip"].digest is None


def test_calibration_and_recipes(spark):
    lines = ["", "not json", '{"predictors":{"groupCounts":{"water":3},"areaKm2":2.5},"actualBytes":10}', '{"predictors":{}}',
             '{"predictors":{"areaKm2":1,"wrist":true},"actualBytes":5,"stageSeconds":[["extract",1.5]]}']
    got = records.samples(spark.createDataFrame([(x,) for x in lines], "line string")).orderBy("actual_bytes").collect()
    assert [(r.water, r.area_km2, r.wrist, r.relief) for r in got] == [(0, 1.0, True, "off"), (3, 2.5, False, "off")]
    docs = spark.createDataFrame([("a", '{"name":"m","preset":"full"}'), ("b", "{{"), ("c", '{"name":"n","contours":{"intervalM":50}}')], "path string, text string")
    got = {r.path: r for r in records.recipes(docs).collect()}
    assert set(got) == {"a", "c"} and (got["a"].contour_interval_m, got["c"].contour_interval_m, got["c"].index_m) == (10, 50, 100)
    p = spark.createDataFrame([("a", '{"id":"x","displayName":"X","matchModels":["m"]}'), ("b", "[")], "path string, text string")
    good, bad = records.profiles(p)
    assert [r.profile for r in good.collect()] == ["x"] and [r.path for r in bad.collect()] == ["b"]


def test_registers(spark, folder):
    head = "﻿adr_status;ADR_OFFICIAL;ADR_EASTING;ADR_NORTHING;STN_LABEL;ADR_NUMBER;ZIP_LABEL\n"
    body = "real;true;10;10;Weg;1;4052 Basel\nREAL;TRUE;10;10; Weg ;2;Bern\nplanned;true;x;1;a;1;b\nreal;true;x;1;a;1;b\nreal;true;99;1;a;1;b\nreal;true;1;1;;1;b\n"
    put(folder, "a.csv", head + body)
    df = addresses.read_addresses(spark, folder + "/a.csv")
    s = addresses.stats(df, 0.0, 0.0, 20.0, 20.0).first()
    assert (s.scanned, s.kept, s.unofficial, s.malformed) == (6, 2, 1, 2)
    k = addresses.kept(df, 0.0, 0.0, 20.0, 20.0).orderBy("number").collect()
    assert [(r.street, r.postcode, r.locality) for r in k] == [("Weg", "4052", "Basel"), ("Weg", "", "Bern")]
    with pytest.raises(ValueError):
        addresses.read_addresses(spark, put(folder, "bad.csv", "a;b\n1;2\n"))
    names_dir = os.path.join(folder, "n")
    os.mkdir(names_dir)
    put(names_dir, "a.csv", "﻿UUID;NAME;SPRACHCODE\nu1;Genf;Hochdeutsch x\nu1;Genève;Franzoesisch\nu1;Geneve;Franzoesisch\n")
    put(names_dir, "b.csv", "NAME;SPRACHCODE;UUID\nZweit;Franzoesisch;u1\nSion;Franzoesisch;u2\n ;Franzoesisch;u3\n")
    read = names.read_names(spark, names_dir)
    got = names.first_names(names.in_language(read, "french"), ["file", "block", "line"]).collect()
    assert {(r.uuid, r.name) for r in got} == {("u1", "Genève"), ("u2", "Sion")}


def test_registers_of_several_headers(spark, folder):
    """Files with columns in another order, and files of one name in two folders."""
    head = "ADR_STATUS;ADR_OFFICIAL;ADR_EASTING;ADR_NORTHING;STN_LABEL;ADR_NUMBER;ZIP_LABEL\n"
    other = "ZIP_LABEL;ADR_NUMBER;STN_LABEL;ADR_NORTHING;ADR_EASTING;ADR_OFFICIAL;ADR_STATUS\n"
    base = os.path.join(folder, "r")
    for name in ("a", "b"):
        os.makedirs(os.path.join(base, name))
    put(os.path.join(base, "a"), "x.csv", head + "real;true;1;1;Weg;1;4052 Basel\nreal;true;2;1;Weg;2;4052 Basel\n")
    put(os.path.join(base, "b"), "x.csv", other + "4052 Basel;3;Weg;1;3;true;real\n4052 Basel;4;Weg;1;4;true;planned\n")
    s = addresses.stats(addresses.read_addresses(spark, base + "/*"), 0.0, 0.0, 20.0, 20.0).first()
    assert (s.scanned, s.kept, s.unofficial, s.malformed) == (4, 3, 1, 0)
    base = os.path.join(folder, "m")
    for name, text in (("a", "UUID;NAME;SPRACHCODE\nu1;Genf;Hochdeutsch\n"), ("b", "SPRACHCODE;UUID;NAME\nHochdeutsch;u2;Sitten\n")):
        os.makedirs(os.path.join(base, name))
        put(os.path.join(base, name), "names.csv", text)
    got = names.read_names(spark, base + "/*").collect()
    assert {(r.uuid, r.code, r.name) for r in got} == {("u1", "Hochdeutsch", "Genf"), ("u2", "Hochdeutsch", "Sitten")}


