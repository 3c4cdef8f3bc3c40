"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakit.session import written


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """``node, root``: each linked node with the smallest node it reaches.

    ``links`` has ``a`` and ``b``. Alternates the large-star and small-star steps: every
    node's larger neighbours move to its smallest, then its smaller ones do. The rows
    never exceed the number of links and the rounds grow with its logarithm. Both steps
    are sums with partial aggregation, so a node with many links is no hot task. Each
    round is written, and one number of it reaches the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = written(edges, label)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.filter("u <> v"), label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(edges, label)
        now = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == seen:
            break
        seen = now
    inner = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return inner.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
