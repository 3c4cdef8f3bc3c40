"""Run records: sources used, storage, and the manifest sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
ELEVATION = ["ch.swisstopo.swissalti3d", "ch.swisstopo.swissaltiregio"]

MANIFEST_SCHEMA = """
    recipe string, created timestamp,
    sources array<struct<collection:string,item:string,files:bigint,bytes:bigint>>,
    features_per_layer map<string,bigint>, stage_seconds array<struct<stage:string,seconds:double>>,
    warnings array<string>, output struct<file:string,bytes:bigint,tiles:int>
"""


def sources_by_release(entries: DataFrame) -> DataFrame:
    """(collection, item, files, bytes, first) of cache entries that know their origin."""
    known = entries.filter("collection is not null and item is not null")
    return known.groupBy("collection", "item").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.min_by("name", "pos").alias("first"))


def storage_use(files: DataFrame) -> DataFrame:
    """(category, bytes) by the first folder of each path; loose files are ``other``."""
    top = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1))
    category = (
        F.when(top.isNull(), "other").when(top.isin(ELEVATION), "elevation")
        .when(top == "builds", "builds").when(top == "recipes", "recipes").when(top == ".quarantine", "quarantine")
        .when(top.startswith("."), "other").otherwise("datasets"))
    return files.groupBy(category.alias("category")).agg(F.sum("bytes").alias("bytes"))


def manifests(runs: DataFrame, sources: DataFrame, layers: DataFrame, stages: DataFrame) -> DataFrame:
    """One nested record per run from tables keyed by ``run``. A run has a handful of
    sources, at most a few dozen layers and seven stages."""
    by = "run"
    src = sources.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("collection", "item", "files", "bytes"))).alias("sources"))
    lay = layers.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("layer", "n")))).alias("features_per_layer"))
    stg = stages.groupBy(by).agg(F.collect_list(F.struct("stage", "seconds")).alias("stage_seconds"))
    return runs.join(src, by, "left").join(lay, by, "left").join(stg, by, "left")


def append_manifests(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)
