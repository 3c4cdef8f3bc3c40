"""The calibration feed: appended samples keep the model's sums up to date.

The normal equations are sums, so every trigger stores its own 77 sums under its batch
number. A repeated batch overwrites itself; the model is the total over all batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakit.plans.estimate import PRIOR, STRONG_LAMBDA, TERMS, _ridge, gram_rows


def store_sums(path: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        gram_rows(batch).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def follow(samples: DataFrame, path: str, checkpoint: str):
    """Start the feed over a stream of samples; returns the running query."""
    return (samples.writeStream.foreachBatch(store_sums(path)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def total_sums(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").groupBy("i", "j").agg(F.sum("v").alias("v"))


def model_from_sums(sums: DataFrame, prior: list[float] = PRIOR, lam: float = STRONG_LAMBDA) -> list[float]:
    """Ridge solution of the stored sums; 77 rows reach the driver."""
    a, b = np.zeros((TERMS, TERMS)), np.zeros(TERMS)
    for i, j, v in sums.select("i", "j", "v").collect():
        if j < 0:
            b[i] = v
        else:
            a[i, j] = a[j, i] = v
    return _ridge(a[None], b[None], np.array([lam]), np.array(prior))[0].tolist()
