"""The feature lake: Parquet laid out so that a box reads few files.

Features are range-partitioned by layer and 10 km cell and sorted inside. Range
partitioning balances by row count, so a city's cell is spread over many files and an
alpine one shares a file with its neighbours. The box columns carry tight statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakit.functions.boxes import box_meets

CELL_M = 10_000.0
BOX = ("min_e", "min_n", "max_e", "max_n")


def with_box(features: DataFrame) -> DataFrame:
    """Add the box of ``parts`` where a feature has none yet."""
    if set(BOX) <= set(features.columns):
        return features
    points = F.flatten(F.transform("parts", lambda p: p["pts"]))
    es, ns = F.transform(points, lambda p: p["e"]), F.transform(points, lambda p: p["n"])
    return features.withColumns(dict(zip(BOX, (F.array_min(es), F.array_min(ns), F.array_max(es), F.array_max(ns)))))


def write_features(features: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """Write (layer, ..., parts) below ``path``, one folder per layer."""
    boxed = with_box(features)
    order = ["layer", F.floor(F.col("min_e") / CELL_M), F.floor(F.col("min_n") / CELL_M), "min_e"]
    spread = boxed.repartitionByRange(files, *order) if files else boxed.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.mode(mode).partitionBy("layer").parquet(path)


def read_features(spark: SparkSession, path: str, layers: list[str] | None = None, box: tuple | None = None) -> DataFrame:
    """Features of some layers whose box meets ``box``; both filters prune files."""
    df = spark.read.parquet(path)
    if layers:
        df = df.filter(F.col("layer").isin(layers))
    if box:
        df = df.filter(box_meets(*[F.col(b) for b in BOX], *[float(v) for v in box]))
    return df
