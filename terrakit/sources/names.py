"""The multilingual name register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakit.sources.addresses import register_field, register_lines

# The start of the language code text, by label language.
LANGUAGE_PREFIX = {
    "german": "Hochdeutsch", "french": "Franzoesisch", "italian": "Italienisch", "romansh": "Rumantsch",
}


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(uuid, code, name, file, block, line) from semicolon files, in file then line order.

    See :func:`terrakit.sources.addresses.register_lines` for headers and order.
    """
    return register_lines(spark, path).select(
        F.trim(register_field("UUID")).alias("uuid"), F.trim(register_field("SPRACHCODE")).alias("code"),
        F.trim(register_field("NAME")).alias("name"), "file", "block", "line",
    ).filter("uuid is not null and code is not null and name is not null")


def in_language(names: DataFrame, language: str) -> DataFrame:
    """Rows whose code starts with the language's prefix and whose name is not blank."""
    prefix = LANGUAGE_PREFIX[language]
    return names.filter(F.col("code").startswith(prefix) & (F.trim("name") != ""))


def first_names(names: DataFrame, order: list[str]) -> DataFrame:
    """One name per uuid, the first in ``order``. Partial aggregation absorbs hot uuids."""
    return names.groupBy("uuid").agg(F.min_by("name", F.struct(*order)).alias("name"))


def relabel(features: DataFrame, names: DataFrame) -> DataFrame:
    """Replace ``name`` by the register's name for the same uuid where there is one."""
    register = names.select(F.col("uuid").alias("__uuid"), F.col("name").alias("__name"))
    return (
        features.join(register, F.col("uuid") == F.col("__uuid"), "left")
        .withColumn("name", F.coalesce("__name", "name"))
        .drop("__uuid", "__name")
    )
