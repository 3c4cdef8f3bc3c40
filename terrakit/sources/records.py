"""Tolerant JSON: calibration lines, recipes and device profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakit.plans.layers import GROUPS

c = F.col
SAMPLE = (
    "predictors struct<groupCounts:map<string,bigint>,areaKm2:double,contourIntervalM:int,relief:string,"
    "slopeClasses:boolean,routing:boolean,addresses:boolean,wrist:boolean>, actualBytes bigint, "
    "stageSeconds array<array<string>>, at bigint, _bad string"
)
RECIPE = (
    "schemaVersion int, name string, deviceId string, preset string, "
    "contours struct<intervalM:int,indexM:int,simplifyM:double>, relief string, slopeClasses boolean, "
    "routing boolean, addresses boolean, labelLanguage string, excludedLayers array<string>, _bad string"
)
PROFILE = (
    "id string, displayName string, matchModels array<string>, "
    "storage struct<recommendedMapBudgetBytes:bigint>, "
    "mapFile struct<maxImgBytes:bigint,maxTilesPerMapset:int,requiresExactFilename:boolean,supportsMultipleMapsets:boolean>, "
    "confidence struct<level:string,notes:string>, _bad string"
)
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


def parsed(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, OPTIONS)


def samples(lines: DataFrame) -> DataFrame:
    """Calibration samples from (line) rows; blank and bad lines are skipped, fields added
    later default."""
    rows = lines.filter(F.trim("line") != "").select(parsed(c("line"), SAMPLE).alias("s")).filter(
        "s._bad is null and s.predictors is not null and s.actualBytes is not null")
    p = c("s.predictors")
    flag = lambda name: F.coalesce(p[name], F.lit(False))
    stages = F.transform(
        F.coalesce(c("s.stageSeconds"), F.array().cast("array<array<string>>")),
        lambda x: F.struct(x[0].alias("stage"), x[1].try_cast("double").alias("seconds")))
    counts = [F.coalesce(F.try_element_at(p["groupCounts"], F.lit(g)), F.lit(0)).alias(g) for g in GROUPS]
    return rows.select(
        *counts, p["areaKm2"].alias("area_km2"), F.coalesce(p["contourIntervalM"], F.lit(0)).alias("contour_interval_m"),
        F.coalesce(p["relief"], F.lit("off")).alias("relief"), flag("slopeClasses").alias("slope_classes"),
        flag("routing").alias("routing"), flag("addresses").alias("addresses"), flag("wrist").alias("wrist"),
        c("s.actualBytes").alias("actual_bytes"), stages.alias("stages"), F.coalesce("s.at", F.lit(0)).alias("at"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return samples(spark.read.text(path).withColumnRenamed("value", "line"))


def recipes(documents: DataFrame) -> DataFrame:
    """Recipes of (path, text) documents with defaults; unreadable ones are skipped."""
    r = documents.select("path", parsed(c("text"), RECIPE).alias("r")).filter("r._bad is null and r.name is not null")
    full = c("r.preset") == "full"
    return r.select(
        "path", F.coalesce("r.schemaVersion", F.lit(1)).alias("schema_version"), "r.name", c("r.deviceId").alias("device_id"),
        F.coalesce("r.preset", F.lit("hiking")).alias("preset"),
        F.coalesce("r.contours.intervalM", F.when(full, 10).otherwise(20)).alias("contour_interval_m"),
        F.coalesce("r.contours.indexM", F.when(full, 50).otherwise(100)).alias("index_m"),
        F.coalesce("r.relief", F.lit("off")).alias("relief"), F.coalesce("r.slopeClasses", F.lit(False)).alias("slope_classes"),
        F.coalesce("r.routing", F.lit(False)).alias("routing"), F.coalesce("r.addresses", F.lit(False)).alias("addresses"),
        F.coalesce("r.labelLanguage", F.lit("local")).alias("label_language"),
        F.coalesce("r.excludedLayers", F.array().cast("array<string>")).alias("excluded"))


def profiles(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(device profiles sorted by name, unreadable documents)."""
    p = documents.select("path", parsed(c("text"), PROFILE).alias("p"))
    bad = p.filter("p._bad is not null or p.id is null").select("path")
    good = p.filter("p._bad is null and p.id is not null").select(
        "path", c("p.id").alias("profile"), c("p.displayName").alias("display_name"), c("p.matchModels").alias("models"),
        c("p.storage.recommendedMapBudgetBytes").alias("budget"), c("p.mapFile.maxImgBytes").alias("max_img_bytes"),
        c("p.mapFile.maxTilesPerMapset").alias("max_tiles"), c("p.confidence.level").alias("level"))
    return good.orderBy("display_name"), bad
