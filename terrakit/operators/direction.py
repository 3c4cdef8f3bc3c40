"""Do ramps run the way traffic does?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakit.operators.spatial import nearest_distance

c = F.col


def verdicts(ramps: DataFrame, motorway: DataFrame, slack: float = 20.0) -> DataFrame:
    """(sid, verdict) of ramps (sid, kind, ax, ay, bx, by): an exit starts nearer to the
    motorway, an entry ends nearer. Ends about as near say nothing."""
    ends = ramps.select(F.inline(F.array(
        F.struct(F.struct("sid", F.lit(0).alias("side")).alias("id"), c("ax").alias("e"), c("ay").alias("n")),
        F.struct(F.struct("sid", F.lit(1).alias("side")).alias("id"), c("bx").alias("e"), c("by").alias("n")),
    )))
    near = nearest_distance(ends, motorway)
    sides = near.groupBy(c("id.sid").alias("sid")).agg(
        F.max(F.when(c("id.side") == 0, c("distance"))).alias("first"),
        F.max(F.when(c("id.side") == 1, c("distance"))).alias("last"))
    forward = F.when(c("kind") == "Ausfahrt", c("first") < c("last")).otherwise(c("last") < c("first"))
    verdict = F.when(F.abs(c("first") - c("last")) < slack, "ambiguous").when(forward, "agree").otherwise("disagree")
    return ramps.join(sides, "sid").select("sid", verdict.alias("verdict"))
