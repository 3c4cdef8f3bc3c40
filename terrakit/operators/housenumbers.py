"""House numbers to the street they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakit.functions.attrs import fold
from terrakit.functions.shapes import segment_distance_sq
from terrakit.operators.cells import cell_of, cells_over

REACH_M = 150.0
CELL = 300.0
c = F.col


def nearest_street(addresses: DataFrame, streets: DataFrame, reach: float = REACH_M) -> DataFrame:
    """(id, sid, distance): the nearest segment of the same folded street name in reach.

    The join key is street and cell together, so a common street name is spread over all
    the places it occurs in.
    """
    box = cells_over(
        F.least("ax", "bx") - reach, F.least("ay", "by") - reach,
        F.greatest("ax", "bx") + reach, F.greatest("ay", "by") + reach, CELL,
    )
    right = streets.select("sid", fold(c("street")).alias("name"), "ax", "ay", "bx", "by", F.inline(box))
    left = addresses.select(
        "id", fold(c("street")).alias("name"), "e", "n", cell_of(c("e"), CELL).alias("cx"), cell_of(c("n"), CELL).alias("cy")
    )
    gap = segment_distance_sq(c("e"), c("n"), c("ax"), c("ay"), c("bx"), c("by"))
    near = left.join(right, ["name", "cx", "cy"]).withColumn("d2", gap).filter(c("d2") <= reach * reach)
    best = near.groupBy("id").agg(F.min(F.struct("d2", "sid")).alias("b"))
    return best.select("id", "b.sid", F.sqrt("b.d2").alias("distance"))
