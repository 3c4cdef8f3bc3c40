"""Column profiles, value domains and audits of wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CARDINALITY_CAP = 300
c = F.col


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, val) with every value as text, nulls included."""
    cells = [F.struct(F.lit(name).alias("col"), c(name).cast("string").alias("val")) for name in columns]
    return df.select(F.inline(F.array(*cells)))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, val, n) of the values that are not null."""
    return unpivoted(df, columns).filter("val is not null").groupBy("col", "val").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, columns: list[str], cap: int = CARDINALITY_CAP) -> DataFrame:
    """(col, nulls, cardinality, top, top_n): exact up to ``cap`` values, else ``>cap``.

    A first pass sketches the distinct counts and counts the nulls of all columns into one
    row; columns far beyond the cap are settled by that, so the exact counting never
    shuffles keys of a unique column. Anything near the cap is counted exactly.
    """
    row = df.agg(
        *[F.approx_count_distinct(name).alias(f"d_{name}") for name in columns],
        *[F.count_if(c(name).isNull()).alias(f"n_{name}") for name in columns],
    ).first()
    wide = [name for name in columns if row[f"d_{name}"] > 4 * cap]
    narrow = [name for name in columns if name not in wide]
    spark = df.sparkSession
    nulls = spark.createDataFrame([(name, row[f"n_{name}"]) for name in columns], "col string, nulls long")
    over = spark.createDataFrame([(n, cap + 1) for n in wide], "col string, k long").withColumn(
        "top", F.lit(None).cast("string")).withColumn("top_n", F.lit(None).cast("bigint"))
    exact = over.limit(0)
    if narrow:
        exact = value_counts(df, narrow).groupBy("col").agg(
            F.count(F.lit(1)).alias("k"), F.min_by("val", F.struct(-c("n"), "val")).alias("top"), F.max("n").alias("top_n"))
    known = over.unionByName(exact)
    text = F.when(c("k") > cap, f">{cap}").otherwise(c("k").cast("string"))
    hide = c("k") > cap
    return nulls.join(known, "col", "left").select(
        "col", "nulls", F.coalesce(text, F.lit("0")).alias("cardinality"),
        F.when(~hide, c("top")).alias("top"), F.when(~hide, c("top_n")).alias("top_n"))


def most_common(counts: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most frequent values per column, ties by value, with their rank.

    Counts are pre-aggregated, and the engine keeps only ``limit`` rows per task and
    column before the shuffle.
    """
    window = Window.partitionBy("col").orderBy(c("n").desc(), "val")
    return counts.withColumn("rank", F.row_number().over(window)).filter(c("rank") <= limit)


def domain(counts: DataFrame, limit: int) -> DataFrame:
    """Up to ``limit`` values per column and whether there are more."""
    top = most_common(counts, limit + 1)
    more = top.groupBy(c("col").alias("__col")).agg((F.max("rank") > limit).alias("overflow"))
    return top.filter(c("rank") <= limit).join(more, c("col") == c("__col")).drop("__col")


def duplicates(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, distinct), by counting pre-aggregated values."""
    counted = value_counts(df, columns).groupBy("col").agg(F.count(F.lit(1)).alias("distinct"))
    names = df.sparkSession.createDataFrame([(n,) for n in columns], "col string")
    return names.join(counted, "col", "left").select("col", F.coalesce("distinct", F.lit(0)).alias("distinct"))
