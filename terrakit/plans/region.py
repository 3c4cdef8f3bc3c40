"""What still has to be built, and the assembly of a region from its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regions_to_build(wanted: DataFrame, clips: DataFrame, stats: DataFrame) -> DataFrame:
    """Keys without a finished clip or without its statistics; both must exist to reuse."""
    finished = clips.join(stats, "region", "left_semi")
    return wanted.join(finished, "region", "left_anti")


def assemble(
    sources: dict[str, DataFrame | None], winter: bool, cycle: bool
) -> tuple[DataFrame, list[str]]:
    """Union of the sources a preset reads, and warnings for those that are absent.

    ``base`` must exist. ``huts`` are always read, ``winter`` and ``cycle`` when asked.
    Columns a source lacks become null.
    """
    out = sources.get("base")
    if out is None:
        raise ValueError("the base source is required")
    asked = ["huts"] + (["winter"] if winter else []) + (["cycle"] if cycle else [])
    warnings = []
    out = out.withColumn("source", F.lit("base"))
    for name in asked:
        part = sources.get(name)
        if part is None:
            warnings.append(f"{name} data is not available, so the map has none of it")
        else:
            out = out.unionByName(part.withColumn("source", F.lit(name)), allowMissingColumns=True)
    return out, warnings
