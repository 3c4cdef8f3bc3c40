"""Lines as point tables (key, i, e, n, ...), for lines of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakit.functions.shapes import clip_span
from terrakit.operators.ordered import CHUNK, ranked, running_total, with_previous


def segments(points: DataFrame, key: str, extra: list[tuple] = ()) -> DataFrame:
    """Rows with the previous point as (ae, an); the first point of a line has none."""
    return with_previous(points, [key], "i", [("e", "ae"), ("n", "an"), *extra])


def lengths(points: DataFrame, key: str) -> DataFrame:
    step = F.hypot(F.col("e") - F.col("ae"), F.col("n") - F.col("an"))
    return segments(points, key).groupBy(key).agg(
        F.coalesce(F.sum(step), F.lit(0.0)).alias("length_m"), F.count(F.lit(1)).alias("points")
    )


def ascents(points: DataFrame, key: str) -> DataFrame:
    """Sum of rises between points that have an elevation."""
    known = ranked(
        points.filter("ele is not null").select(key, "i", "ele"),
        [key], F.floor(F.col("i") / CHUNK), ["i"], "__rank",
    )
    steps = with_previous(known, [key], "__rank", [("ele", "before")])
    rise = F.greatest(F.col("ele") - F.col("before"), F.lit(0.0))
    return steps.groupBy(key).agg(F.coalesce(F.sum(rise), F.lit(0.0)).alias("ascent_m"))


def clip_segments(points: DataFrame, key: str, min_e, min_n, max_e, max_n) -> DataFrame:
    """One row per segment that meets the box: (key, i, part, pe, pn, qe, qn).

    ``part`` counts from 1 inside each line and rises where a segment does not start
    exactly where the one before it ended.
    """
    box = [F.lit(float(v)) for v in (min_e, min_n, max_e, max_n)]
    two_back = [("e", "ze", 2), ("n", "zn", 2)]
    seg = segments(points, key, two_back).filter("ae is not null")
    c = F.col
    seg = seg.withColumn("span", clip_span(c("ae"), c("an"), c("e"), c("n"), *box))
    seg = seg.filter("span is not null").withColumn(
        "before", F.when(c("ze").isNotNull(), clip_span(c("ze"), c("zn"), c("ae"), c("an"), *box))
    )

    def along(a, b, t):
        return a + t * (b - a)

    t0, t1, s1 = c("span.t0"), c("span.t1"), c("before.t1")
    seg = seg.select(
        key, "i", "chunk",
        along(c("ae"), c("e"), t0).alias("pe"), along(c("an"), c("n"), t0).alias("pn"),
        along(c("ae"), c("e"), t1).alias("qe"), along(c("an"), c("n"), t1).alias("qn"),
        along(c("ze"), c("ae"), s1).alias("le"), along(c("zn"), c("an"), s1).alias("ln"),
    )
    starts = ~F.coalesce((c("le") == c("pe")) & (c("ln") == c("pn")), F.lit(False))
    numbered = running_total(seg, [key], "i", starts.cast("bigint"), "part")
    return numbered.select(key, "i", "part", "pe", "pn", "qe", "qn")


def drop_repeats(points: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose ``columns`` equal those of the row before them are dropped."""
    marked = with_previous(points, [key], "i", [(c, f"__p_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    return marked.filter(~same | (F.col("i") == 1)).drop("chunk", *[f"__p_{c}" for c in columns])
