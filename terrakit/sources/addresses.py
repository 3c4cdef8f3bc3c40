"""The address register: semicolon CSV, cleaned by ordered reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakit.functions.attrs import locality, postcode
from terrakit.functions.boxes import box_has

BOM = "﻿"
COLUMNS = [
    "STN_LABEL", "ADR_NUMBER", "ZIP_LABEL", "ADR_STATUS", "ADR_OFFICIAL", "ADR_EASTING", "ADR_NORTHING",
]


def file_heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, head): the first line of each file, without a byte-order mark."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    first = lines.filter("block = 0").groupBy("path").agg(F.min_by("value", "line").alias("head"))
    return first.withColumn("head", F.replace("head", F.lit(BOM), F.lit("")))


def register_lines(spark: SparkSession, path: str, heads: DataFrame | None = None) -> DataFrame:
    """(fields, columns, file, block, line): the rows of semicolon files without quoting,
    each beside the column names of its own file.

    Files may differ in the order of their columns and share a name in different folders.
    A line that repeats its file's header, as joined-up files have, is no row; nor is an
    empty line. ``block`` is the byte offset of the split a line came from and ``line``
    grows inside one split, so (file, block, line) is the order of the lines on disk.
    """
    heads = file_heads(spark, path) if heads is None else heads
    lines = spark.read.text(path).select(
        F.replace("value", F.lit(BOM), F.lit("")).alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    joined = lines.join(heads, F.col("file") == F.col("path"))
    return joined.filter("value <> head and value <> ''").select(
        F.split("value", ";").alias("fields"), F.transform(F.split("head", ";"), F.trim).alias("columns"),
        "file", "block", "line",
    )


def register_field(name: str) -> Column:
    """The text of a named column of :func:`register_lines`; null where its file has none."""
    place = F.array_position("columns", name).cast("int")
    return F.when(place > 0, F.try_element_at("fields", F.greatest(place, F.lit(1))))


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    """The address columns of all files, in lower case; empty text is null.

    Column order and case do not matter and may differ between files. A file without one
    of the columns is an error.
    """
    heads = file_heads(spark, path).withColumn("head", F.lower("head"))
    columns = F.transform(F.split("head", ";"), F.trim)
    missing = F.array_except(F.array(*[F.lit(n.lower()) for n in COLUMNS]), columns)
    lacking = heads.select("path", missing.alias("missing")).filter("size(missing) > 0").first()
    if lacking:
        raise ValueError(f"address columns missing in {lacking['path']}: {', '.join(lacking['missing'])}")
    rows = register_lines(spark, path, heads).filter(
        F.lower(F.array_join("fields", ";")) != F.array_join("columns", ";")
    )
    return rows.select(*[F.nullif(register_field(n.lower()), F.lit("")).alias(n.lower()) for n in COLUMNS])


def with_reason(df: DataFrame, min_e: float, min_n: float, max_e: float, max_n: float) -> DataFrame:
    """Why each row is kept or not; the first failed test names the reason."""
    placed = (
        df.withColumn("e", F.col("adr_easting").try_cast("double"))
        .withColumn("n", F.col("adr_northing").try_cast("double"))
        .withColumn("street", F.trim(F.coalesce("stn_label", F.lit(""))))
        .withColumn("number", F.trim(F.coalesce("adr_number", F.lit(""))))
    )
    status = F.lower(F.coalesce("adr_status", F.lit("")))
    official = F.lower(F.coalesce("adr_official", F.lit("")))
    reason = (
        F.when(status != "real", "unofficial")
        .when(official != "true", "unofficial")
        .when(F.col("e").isNull() | F.col("n").isNull(), "malformed")
        .when(~box_has(F.col("e"), F.col("n"), min_e, min_n, max_e, max_n), "outside")
        .when((F.col("street") == "") | (F.col("number") == ""), "malformed")
        .otherwise("kept")
    )
    return placed.withColumn("reason", reason)


def kept(df: DataFrame, min_e: float, min_n: float, max_e: float, max_n: float) -> DataFrame:
    return (
        with_reason(df, min_e, min_n, max_e, max_n)
        .filter("reason = 'kept'")
        .withColumn("postcode", postcode(F.col("zip_label")))
        .withColumn("locality", locality(F.col("zip_label")))
    )


def stats(df: DataFrame, min_e: float, min_n: float, max_e: float, max_n: float) -> DataFrame:
    """One row: scanned, kept, unofficial, malformed."""
    r = with_reason(df, min_e, min_n, max_e, max_n)
    return r.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("reason") == "kept").alias("kept"),
        F.count_if(F.col("reason") == "unofficial").alias("unofficial"),
        F.count_if(F.col("reason") == "malformed").alias("malformed"),
    )
