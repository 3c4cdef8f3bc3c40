"""Ordered computations that survive a hot key.

A plain window over ``partitionBy(key)`` puts a whole key into one task. The operators
here work in two levels instead: a window inside bounded (key, bucket) groups, and a
window over the much smaller table of bucket totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 65_536
CROWD = 2_000_000


def _offsets(df: DataFrame, keys: list[str], bucket: str, totals: dict[str, Column]) -> DataFrame:
    """Sums over all earlier buckets of the same key, one column per entry of ``totals``."""
    sums = df.groupBy(*keys, bucket).agg(*[total.alias(f"__t_{name}") for name, total in totals.items()])
    window = (
        Window.partitionBy(*keys)
        .orderBy(bucket)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = [
        F.coalesce(F.sum(f"__t_{name}").over(window), F.lit(0)).alias(f"__before_{name}") for name in totals
    ]
    return sums.select(*keys, bucket, *before)


def _attach(df: DataFrame, side: DataFrame, names: list[str]) -> DataFrame:
    renamed = side.select(
        *[F.col(n).alias(f"__k_{n}") for n in names],
        *[c for c in side.columns if c not in names],
    )
    cond = F.lit(True)
    for name in names:
        cond = cond & F.col(name).eqNullSafe(F.col(f"__k_{name}"))
    return df.join(renamed, cond, "left").drop(*[f"__k_{n}" for n in names])


def ranked(
    df: DataFrame, keys: list[str], bucket: Column, order: list, out: str,
    fine: Column | None = None, crowd: int = CROWD,
) -> DataFrame:
    """1-based position inside each key, in ``order``.

    ``bucket`` must be monotone in ``order`` (a date for a timestamp, a leading digit
    group for a coordinate). Only rows that share key and bucket meet in one task. Where
    more than ``crowd`` rows do, they are told apart by ``fine``, a narrower value that is
    monotone inside the bucket.
    """
    work = df.withColumn("__bucket", F.struct(bucket.alias("b")))
    if fine is not None:
        counts = work.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__rows"))
        dense = counts.filter(F.col("__rows") > crowd).select(*keys, "__bucket", F.lit(True).alias("__dense"))
        work = _attach(work, dense, [*keys, "__bucket"])
        work = work.withColumn(
            "__bucket", F.struct(F.col("__bucket.b").alias("b"), F.when(F.col("__dense"), fine).alias("f"))
        ).drop("__dense")
    inner = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    local = work.withColumn("__local", F.row_number().over(inner).cast("bigint"))
    offsets = _offsets(work, keys, "__bucket", {"n": F.count(F.lit(1))})
    joined = _attach(local, offsets, [*keys, "__bucket"])
    return joined.withColumn(out, F.col("__local") + F.col("__before_n")).drop(
        "__bucket", "__local", "__before_n"
    )


def _spread(df: DataFrame, index: str, reach: int, chunk: int) -> DataFrame:
    """Send the ``reach`` rows beside a chunk border to the neighbouring chunk too."""
    position = F.col(index).cast("bigint")
    home = F.floor((position - 1) / chunk)
    beside = F.floor((position - 1 + reach) / chunk)
    return df.withColumn(
        "chunk", F.explode(F.array_distinct(F.array(home, beside)))
    ).withColumn("__home", F.col("chunk") == home)


def with_previous(
    df: DataFrame, keys: list[str], index: str, columns: list[tuple], chunk: int = CHUNK
) -> DataFrame:
    """Add earlier rows' values, by a dense 1-based ``index`` inside each key.

    ``columns`` holds (source, target) or (source, target, offset). Rows beside a chunk
    border also go to the next chunk, so one shuffle on (key, chunk) is enough and no key
    is gathered whole. The ``chunk`` column stays, for operators that follow.
    """
    steps = [(c[0], c[1], c[2] if len(c) > 2 else 1) for c in columns]
    spread = _spread(df, index, max(s[2] for s in steps), chunk)
    window = Window.partitionBy(*keys, "chunk").orderBy(index)
    added = {target: F.lag(source, offset).over(window) for source, target, offset in steps}
    return spread.withColumns(added).filter("__home").drop("__home")


def with_next(
    df: DataFrame, keys: list[str], index: str, columns: list[tuple], chunk: int = CHUNK
) -> DataFrame:
    """Mirror image of :func:`with_previous`."""
    steps = [(c[0], c[1], c[2] if len(c) > 2 else 1) for c in columns]
    spread = _spread(df, index, -max(s[2] for s in steps), chunk)
    window = Window.partitionBy(*keys, "chunk").orderBy(index)
    added = {target: F.lead(source, offset).over(window) for source, target, offset in steps}
    return spread.withColumns(added).filter("__home").drop("__home")


def running_totals(
    df: DataFrame, keys: list[str], index: str, values: dict[str, Column], chunk: int = CHUNK
) -> DataFrame:
    """Inclusive running sums along ``index`` inside each key; ``values`` maps a new
    column to what it sums."""
    work = df
    if "chunk" not in df.columns:
        work = work.withColumn("chunk", F.floor((F.col(index).cast("bigint") - 1) / chunk))
    work = work.withColumns({f"__v_{name}": value for name, value in values.items()})
    inner = (
        Window.partitionBy(*keys, "chunk")
        .orderBy(index)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = work.withColumns({f"__l_{name}": F.sum(f"__v_{name}").over(inner) for name in values})
    offsets = _offsets(work, keys, "chunk", {name: F.sum(f"__v_{name}") for name in values})
    joined = _attach(local, offsets, [*keys, "chunk"])
    added = {name: F.col(f"__l_{name}") + F.col(f"__before_{name}") for name in values}
    spare = [f"__{kind}_{name}" for kind in ("v", "l", "before") for name in values]
    return joined.withColumns(added).drop(*spare)


def running_total(
    df: DataFrame, keys: list[str], index: str, value: Column, out: str, chunk: int = CHUNK
) -> DataFrame:
    return running_totals(df, keys, index, {out: value}, chunk)
