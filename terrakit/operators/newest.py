"""Newest of several per key, by partial aggregation: a hot key costs no more than others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], rank: list[Column], keep: list[str]) -> DataFrame:
    """The row with the greatest ``rank`` per key; ``rank`` must not tie."""
    best = F.max_by(F.struct(*keep), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]))
    return rows.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def newest_tiles(assets: DataFrame) -> DataFrame:
    """Newest asset per cell; of equal years the first seen (lowest item) wins."""
    return newest(assets, ["e_km", "n_km"], [F.col("yr"), -F.col("item")], ["yr", "item", "name"])


def missing_cells(wanted: DataFrame, have: DataFrame) -> DataFrame:
    return wanted.distinct().join(have, ["e_km", "n_km"], "left_anti")
