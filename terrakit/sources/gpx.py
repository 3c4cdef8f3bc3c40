"""GPX tracks, routes and waypoints, as column expressions over whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakit.operators.ordered import CHUNK, ranked, running_totals
from terrakit.session import cut_lineage

c = F.col
TAG = r"<(?:[\w.-]+:)?"
PIECES = TAG + r"(?:trkseg|rte|trkpt|rtept|wpt|trk)[\s/>]"


def _unescaped(text: Column) -> Column:
    # The ampersand last, so an escaped entity is not read twice.
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(letter))
    return text


def _inner(name: str) -> Column:
    return F.trim(F.regexp_extract("piece", rf"(?s){TAG}{name}(?:\s[^>]*)?>([^<]*)<", 1))


def pieces(documents: DataFrame) -> DataFrame:
    """(path, pos, kind, lat, lon, ele, name, closes): a document cut before every track,
    segment, route and point tag. Prefixes are ignored; a cut-off document keeps all points
    whose tag is complete."""
    clean = F.regexp_replace("text", r"(?s)<!--.*?-->", "")
    cut = documents.select("path", F.posexplode(F.split(clean, f"(?={PIECES})")).alias("pos", "piece")).filter("pos > 0")
    tag = F.regexp_extract("piece", r"(?s)^<[^>]*>", 0)

    def attribute(name):
        return F.trim(F.regexp_extract(tag, rf"\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)).try_cast("double")

    return cut.select(
        "path", c("pos").cast("bigint").alias("pos"), F.regexp_extract("piece", TAG + r"(\w+)", 1).alias("kind"),
        attribute("lat").alias("lat"), attribute("lon").alias("lon"), _inner("ele").try_cast("double").alias("ele"),
        _unescaped(_inner("name")).alias("name"),
        c("piece").rlike(r"</(?:[\w.-]+:)?(?:trkseg|rte|trk)\s*>").alias("closes"),
    )


def waypoints(documents: DataFrame) -> DataFrame:
    p = pieces(documents).filter("kind = 'wpt' and lat is not null and lon is not null")
    return p.select("path", "pos", "lon", "lat", "ele", "name")


def track_points(documents: DataFrame) -> DataFrame:
    """(path, track, i, lon, lat, ele, name): segments and routes stay separate tracks,
    numbered in file order. Points outside any segment form tracks of their own.

    A point's track follows from three counts up to it: segments opened, segments closed,
    tracks begun. They come from one running sum over all pieces.
    """
    one = lambda test: test.cast("bigint")
    # The text is cut up once; several passes over the pieces follow.
    p = running_totals(cut_lineage(pieces(documents)), ["path"], "pos", {
        "opened": one(c("kind").isin("trkseg", "rte")), "shut": one(c("closes")), "trk": one(c("kind") == "trk")})
    where = ["path", "opened", "shut", "trk"]
    p = p.withColumn("shut", c("shut") - one(c("closes"))).drop("chunk")
    names = p.filter("kind = 'trk' and name <> ''").groupBy("path", "trk").agg(F.min_by("name", "pos").alias("trk_name"))
    routes = p.filter("kind = 'rte' and name <> ''").groupBy("path", "opened").agg(F.min_by("name", "pos").alias("rte_name"))
    points = p.filter("kind in ('trkpt', 'rtept') and lat is not null and lon is not null")
    tracks = points.groupBy(*where).agg(F.min("pos").alias("start"))
    tracks = ranked(tracks, ["path"], F.floor(c("start") / CHUNK), ["start"], "track")
    tracks = tracks.join(names, ["path", "trk"], "left").join(routes, ["path", "opened"], "left").select(
        *where, "track", F.coalesce("rte_name", "trk_name").alias("name"))
    numbered = ranked(points.select(*where, "pos", "lon", "lat", "ele"), ["path"], F.floor(c("pos") / CHUNK), ["pos"], "i")
    return numbered.join(tracks, where).select("path", "track", "i", "lon", "lat", "ele", "name")


def read_documents(spark: SparkSession, path: str, pattern: str = "*.gpx") -> DataFrame:
    """(path, text): one row per file; invalid bytes are replaced."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path)
    return files.select(c("_metadata.file_path").alias("path"), c("value").alias("text"))


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    return track_points(read_documents(spark, path))
