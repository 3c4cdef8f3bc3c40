"""Catalogue pages: releases and their assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakit.functions.attrs import multihash_digest

c = F.col
ITEM = (
    "id string, properties struct<datetime:string>, bbox array<double>, "
    "assets map<string,struct<href:string,type:string,`file:checksum`:string>>"
)
# Asset suffixes by preference, and what they hold.
PREFERENCE = [
    (".gpkg.zip", "zippedGeoPackage"), (".csv.zip", "zippedCsv"),
    (".shp.zip", "zippedShapefiles"), (".gpkg", "plainGeoPackage"),
]


def items(pages: DataFrame) -> DataFrame:
    """(page, id, datetime, bbox, assets) of (page, text) rows. Each feature is parsed on
    its own, so a malformed one does not spoil its page."""
    features = F.from_json("text", "features array<string>")["features"]
    return pages.select("page", F.explode(features).alias("f")).select("page", F.from_json("f", ITEM).alias("i")).select(
        "page", F.coalesce("i.id", F.lit("")).alias("id"), c("i.properties.datetime").alias("datetime"), "i.bbox", "i.assets")


def assets(pages: DataFrame) -> DataFrame:
    """(page, id, name, href, media_type, digest): assets without an address are dropped,
    a checksum that is no SHA-256 multihash is null."""
    rows = items(pages).select("page", "id", F.explode("assets").alias("name", "a")).filter("a.href is not null")
    return rows.select(
        "page", "id", "name", "a.href", c("a.type").alias("media_type"),
        multihash_digest(c("a").getField("file:checksum")).alias("digest"))


def primary_assets(assets_: DataFrame) -> DataFrame:
    """(item, name, kind): the preferred asset of each item, the first on ties."""
    place, kind = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, (suffix, text) in reversed(list(enumerate(PREFERENCE))):
        hit = c("name").endswith(suffix)
        place, kind = F.when(hit, F.lit(k)).otherwise(place), F.when(hit, F.lit(text)).otherwise(kind)
    ranked = assets_.withColumn("place", place).withColumn("kind", kind).filter("place is not null")
    best = ranked.groupBy("item").agg(F.min_by(F.struct("name", "kind"), F.struct("place", "pos")).alias("b"))
    return best.select("item", "b.name", "b.kind")
