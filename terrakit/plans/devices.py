"""Device limits, overrides, matching and output checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The share of a stated limit that is used, by how well it is known.
CONFIDENCE = {"vendor": 1.0, "measured": 1.0, "community": 0.8, "assumed": 0.7}
MAX_FILE_BYTES = 4 * 1024**3 - 1
FALLBACK = {True: "generic-fenix", False: "generic-edge"}


def effective_limits(profiles: DataFrame, overrides: DataFrame, limits: list[str]) -> DataFrame:
    """Limits after the safety share; an override counts as measured."""
    theirs = overrides.select(
        F.col("id").alias("__oid"), *[F.col(c).alias(f"__o_{c}") for c in limits]
    )
    joined = profiles.join(theirs, F.col("id") == F.col("__oid"), "left")
    level = F.when(F.col("__oid").isNotNull(), "measured").otherwise(F.col("level"))
    share = F.lit(None).cast("double")
    for name, factor in CONFIDENCE.items():
        share = F.when(level == name, F.lit(factor)).otherwise(share)
    return joined.select(
        "id", level.alias("level"),
        *[F.floor(F.coalesce(f"__o_{c}", c) * share).cast("bigint").alias(c) for c in limits],
    )


def match_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests (request, model, wrist) to a profile id: by model text, else by family.

    The first profile in ``pos`` order wins where several list the same model.
    """
    models = (
        profiles.select("profile", "pos", F.explode("models").alias("m"))
        .groupBy(F.lower(F.trim("m")).alias("__m"))
        .agg(F.min_by("profile", "pos").alias("__hit"))
    )
    fallback = F.when(F.col("wrist"), FALLBACK[True]).otherwise(FALLBACK[False])
    known = profiles.select(F.col("profile").alias("__known"))
    return (
        requests.join(models, F.lower(F.trim("model")) == F.col("__m"), "left")
        .withColumn("__fallback", fallback)
        .join(known, F.col("__fallback") == F.col("__known"), "left")
        .select("request", F.coalesce("__hit", "__known").alias("profile"))
    )


def output_problems(file_bytes: Column, tiles: Column, max_bytes: Column, max_tiles: Column) -> Column:
    """ARRAY of the limits an output breaks, each ``code key=value ...``, in a fixed order."""
    found = F.array(
        F.when(file_bytes > max_bytes, F.concat(
            F.lit("bytes_over_device is="), file_bytes.cast("string"), F.lit(" limit="), max_bytes.cast("string"))),
        F.when(file_bytes > MAX_FILE_BYTES, F.lit(f"bytes_over_file_system limit={MAX_FILE_BYTES}")),
        F.when(tiles > max_tiles, F.concat(
            F.lit("tiles_over_device is="), tiles.cast("string"), F.lit(" limit="), max_tiles.cast("string"))),
    )
    return F.filter(found, lambda x: x.isNotNull())
