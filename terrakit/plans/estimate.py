"""Output size model: prediction, refitting, cross-validation, stage weights, verdicts.

A predictor row has the seven group counts (landCover, water, transport, built, names,
winter, cycling), area_km2, contour_interval_m, relief, slope_classes, routing,
addresses, wrist. A sample adds actual_bytes.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakit.plans.layers import DEFAULT, GROUPS

# The shipped model, in term order, and the measured terms beside it.
PRIOR = [
    48000.0,  # intercept
    14.0, 12.0, 18.0, 9.0, 26.0, 16.0, 16.0,  # the seven groups
    1900.0,  # contour bytes per km2 at 20 m
    760.0, 150.0,  # relief bytes per km2: detailed, gentle
]
WRIST_FEATURE_FACTOR, WRIST_SLOPE_FACTOR = 0.41, 0.55
SLOPE_BYTES_PER_KM2 = 3568.0
ROUTING_BYTES_PER_TRANSPORT = 33.7
ADDRESS_BYTES, ADDRESSES_PER_BUILDING = 10.5, 0.59
LAMBDAS = [0.0, 1e2, 1e3, 1e4, 1e5, 1e6, 1e7, 1e8, 1e9, 1e10, 1e11]
STRONG_LAMBDA = 1e9
# Stages in build order and their default share of a build.
STAGES = ["extract", "elevation", "contours", "relief", "split", "compile", "verify"]
STAGE_SHARE = [0.0372, 0.3254, 0.4336, 0.0068, 0.0558, 0.1411, 0.0001]

TERMS = len(PRIOR)
FLAGS = {"slope_classes": False, "routing": False, "addresses": False, "wrist": False}


def with_defaults(df: DataFrame) -> DataFrame:
    """Add predictor columns older logs do not have."""
    out = df
    for name in GROUPS:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(0).cast("bigint"))
    for name, value in {**FLAGS, "contour_interval_m": 0, "relief": "off"}.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value))
    return out


def _get(name: str) -> Column:
    return F.col(name)


def terms(get=_get) -> list[Column]:
    """The eleven model terms. ``get`` maps a predictor name to its column."""
    share = F.when(get("wrist"), F.lit(WRIST_FEATURE_FACTOR)).otherwise(F.lit(1.0))
    interval = get("contour_interval_m")
    return [
        F.lit(1.0),
        *[get(g).cast("double") * share for g in GROUPS],
        F.when(interval > 0, get("area_km2") * (F.lit(20.0) / F.greatest(interval, F.lit(1)))).otherwise(0.0),
        F.when(get("relief") == "detailed", get("area_km2")).otherwise(0.0),
        F.when(get("relief") == "gentle", get("area_km2")).otherwise(0.0),
    ]


def adjustment(get=_get) -> Column:
    """Bytes of slope areas, roads and addresses: added to a prediction, taken off an
    observation before fitting."""
    slope, roads, doors = adjustments(get)
    return slope + roads + doors


def adjustments(get=_get) -> list[Column]:
    """The parts of the adjustment: slope areas, roads, addresses."""
    style = F.when(get("wrist"), F.lit(WRIST_SLOPE_FACTOR)).otherwise(F.lit(1.0))
    slope = F.when(get("slope_classes"), get("area_km2") * SLOPE_BYTES_PER_KM2 * style).otherwise(0.0)
    roads = F.when(get("routing"), get("transport") * ROUTING_BYTES_PER_TRANSPORT).otherwise(0.0)
    doors = F.when(get("addresses"), get("built") * ADDRESSES_PER_BUILDING * ADDRESS_BYTES).otherwise(0.0)
    return [slope, roads, doors]


def predict(coefficients: list[float] | None = None, get=_get) -> Column:
    """Predicted bytes, never negative, truncated.

    The model's terms come first and the adjustments after them, one by one: truncation
    shows in which order doubles were added.
    """
    products = [x * float(b) for x, b in zip(terms(get), coefficients or PRIOR)]
    total = functools.reduce(operator.add, [*products, *adjustments(get)])
    return F.floor(F.greatest(total, F.lit(0.0))).cast("bigint")


def target(get=_get) -> Column:
    return F.greatest(get("actual_bytes").cast("double") - adjustment(get), F.lit(0.0))


def gram(samples: DataFrame) -> DataFrame:
    """One row of sums: xtx_i_j for i <= j, xty_i, n. One pass, fully pre-aggregated."""
    named = samples.select(*[x.alias(f"x{i}") for i, x in enumerate(terms())], target().alias("y"))
    pairs = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"xtx_{i}_{j}") for i in range(TERMS) for j in range(i, TERMS)]
    sides = [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"xty_{i}") for i in range(TERMS)]
    return named.agg(*pairs, *sides, F.count(F.lit(1)).alias("n"))


def gram_rows(samples: DataFrame) -> DataFrame:
    """The same sums as rows (i, j, v); j = -1 is the right-hand side."""
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"xtx_{i}_{j}").alias("v"))
             for i in range(TERMS) for j in range(i, TERMS)]
    cells += [F.struct(F.lit(i).alias("i"), F.lit(-1).alias("j"), F.col(f"xty_{i}").alias("v")) for i in range(TERMS)]
    return gram(samples).select(F.inline(F.array(*cells)))


def _matrices(samples: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    row = gram(samples).first()
    a, b = np.zeros((TERMS, TERMS)), np.zeros(TERMS)
    if row["n"] == 0:
        return a, b, 0
    for i in range(TERMS):
        b[i] = row[f"xty_{i}"]
        for j in range(i, TERMS):
            a[i, j] = a[j, i] = row[f"xtx_{i}_{j}"]
    return a, b, row["n"]


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solve a stack of systems; the second result tells which ones are singular."""
    a, b = a.copy(), b.copy()
    stack, size = b.shape
    at = np.arange(stack)
    singular = np.zeros(stack, dtype=bool)
    for k in range(size):
        pivot = k + np.abs(a[:, k:, k]).argmax(axis=1)
        a[at, k], a[at, pivot] = a[at, pivot].copy(), a[at, k].copy()
        b[at, k], b[at, pivot] = b[at, pivot].copy(), b[at, k].copy()
        bad = np.abs(a[:, k, k]) < 1e-9
        singular |= bad
        a[bad, k, k] = 1.0
        factor = a[:, k + 1 :, k] / a[:, k, k][:, None]
        a[:, k + 1 :] -= factor[:, :, None] * a[:, k][:, None, :]
        b[:, k + 1 :] -= factor * b[:, k][:, None]
    x = np.zeros_like(b)
    for k in range(size - 1, -1, -1):
        x[:, k] = (b[:, k] - (a[:, k, k + 1 :] * x[:, k + 1 :]).sum(axis=1)) / a[:, k, k]
    return x, singular


def _ridge(a: np.ndarray, b: np.ndarray, lam: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Coefficients pulled toward the prior: never negative, the prior where singular."""
    full = a + lam[:, None, None] * np.eye(TERMS)[None]
    x, singular = solve(full, b + lam[:, None] * prior[None])
    return np.where(singular[:, None], prior[None], np.maximum(x, 0.0))


def fit(samples: DataFrame, prior: list[float] = PRIOR, lam: float = STRONG_LAMBDA) -> tuple[list[float], int]:
    """(coefficients, sample count). Only 77 sums reach the driver."""
    a, b, n = _matrices(samples)
    if n == 0:
        return list(prior), 0
    return _ridge(a[None], b[None], np.array([lam]), np.array(prior))[0].tolist(), n


def mape(samples: DataFrame, coefficients: list[float] | None = None) -> DataFrame:
    """Mean absolute share by which predictions miss; a zero observation counts as 0."""
    actual = F.col("actual_bytes").cast("double")
    miss = F.abs(predict(coefficients).cast("double") - actual)
    error = F.when(actual > 0, miss / F.when(actual > 0, actual).otherwise(1.0)).otherwise(0.0)
    return samples.agg(F.coalesce(F.avg(error), F.lit(0.0)).alias("mape"), F.count(F.lit(1)).alias("n"))


def loocv(samples: DataFrame, prior: list[float] = PRIOR, lambdas: list[float] = LAMBDAS) -> DataFrame:
    """(pos, lambda, mape): each sample predicted by a fit on the others.

    The total sums minus one sample's own products are the sums of the others, so no
    refit reads the data again. Tasks hold the 77 sums and return one row per batch.
    """
    a, b, n = _matrices(samples)
    grid, base = np.array(lambdas), np.array(prior)
    rows = samples.select(
        *[x.alias(f"x{i}") for i, x in enumerate(terms())], target().alias("y"),
        adjustment().alias("adj"), F.col("actual_bytes").cast("double").alias("actual"),
    )

    def run(frames):
        for frame in frames:
            x = frame[[f"x{i}" for i in range(TERMS)]].to_numpy(float)
            y, adj, actual = (frame[k].to_numpy(float) for k in ("y", "adj", "actual"))
            rest_a = a[None] - x[:, :, None] * x[:, None, :]
            rest_b = b[None] - x * y[:, None]
            for pos, lam in enumerate(grid):
                beta = _ridge(rest_a, rest_b, np.full(len(frame), lam), base)
                guess = np.floor(np.maximum((beta * x).sum(axis=1) + adj, 0.0))
                miss = np.where(actual > 0, np.abs(guess - actual) / np.where(actual > 0, actual, 1.0), 0.0)
                yield pd.DataFrame({"pos": [pos], "lam": [lam], "err": [miss.sum()], "cnt": [len(frame)]})

    sums = rows.mapInPandas(run, "pos int, lam double, err double, cnt long")
    error = F.when(F.lit(n) < 3, F.lit(float("inf"))).otherwise(F.sum("err") / F.sum("cnt"))
    return sums.groupBy("pos", F.col("lam").alias("lambda")).agg(error.alias("mape"))


def fit_cv(samples: DataFrame, prior: list[float] = PRIOR) -> tuple[list[float], float]:
    """Coefficients and the ridge strength with the lowest left-out error, first on ties."""
    best = loocv(samples, prior).agg(F.min_by("lambda", F.struct("mape", "pos")).alias("best")).first()["best"]
    best = 1e6 if best is None else best
    return fit(samples, prior, best)[0], best


def current_model(samples: DataFrame, prior: list[float] = PRIOR) -> list[float]:
    """Under three samples hardly move the prior, otherwise let the data choose."""
    few = samples.limit(3).count() < 3
    return fit(samples, prior, STRONG_LAMBDA)[0] if few else fit_cv(samples, prior)[0]


def stage_weights(durations: DataFrame) -> DataFrame:
    """(stage, weight) from (run, stage, seconds): mean share of a run, normalised.

    A run counts once however long it took. Unknown stages count in a run's total only.
    """
    totals = durations.groupBy("run").agg(F.sum("seconds").alias("total")).filter("total > 0")
    shares = durations.join(totals, "run").withColumn("share", F.col("seconds") / F.col("total"))
    runs = totals.agg(F.count(F.lit(1))).scalar()
    mean = shares.filter(F.col("stage").isin(STAGES)).groupBy("stage").agg(F.sum("share").alias("s"))
    whole = mean.agg(F.sum("s")).scalar()
    spark = durations.sparkSession
    names = spark.createDataFrame(list(zip(STAGES, STAGE_SHARE)), "stage string, preset double")
    out = names.join(mean, "stage", "left").withColumn("whole", whole).withColumn("runs", runs)
    usable = (F.col("runs") > 0) & (F.coalesce("whole", F.lit(0.0)) > 0)
    weight = F.when(usable, F.coalesce("s", F.lit(0.0)) / F.col("whole")).otherwise(F.col("preset"))
    return out.select("stage", weight.alias("weight"))


def build_fraction(weights: list[float], stage_index: Column, within: Column) -> Column:
    """Finished share of a build from the stage it is in and its progress there."""
    index = F.least(F.greatest(stage_index, F.lit(0)), F.lit(len(weights)))
    table = F.array(*[F.lit(float(w)) for w in weights])
    before = F.aggregate(F.slice(table, F.lit(1), index), F.lit(0.0), lambda acc, w: acc + w)
    current = F.coalesce(F.try_element_at(table, (index + 1).cast("int")), F.lit(0.0))
    inside = F.least(F.greatest(within, F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest(before + current * inside, F.lit(0.0)), F.lit(1.0))


def eta_seconds(elapsed: Column, fraction: Column) -> Column:
    """Seconds left, null while there is too little to extrapolate from."""
    known = (fraction >= 0.02) & (elapsed >= 2.0) & (fraction < 1.0)
    return F.when(known, elapsed * (1.0 - fraction) / F.when(known, fraction).otherwise(1.0))


DEFAULT_LAYERS = len(DEFAULT.strip().splitlines())


def budget_verdict(estimated: Column, budget: Column, get=_get) -> Column:
    """{over_budget, overshoot_bytes, remedies}: only remedies that would change the
    recipe (contour_interval_m, relief, slope_classes, excluded), most effective first."""
    over = estimated > budget
    interval = get("contour_interval_m")
    remedies = F.array(
        F.when((interval > 0) & (interval < 100), "coarserContours"), F.lit("smallerArea"),
        F.when(get("relief") != "off", "noRelief"), F.when(get("slope_classes"), "noSlopeClasses"),
        F.when(get("excluded") < DEFAULT_LAYERS, "fewerLayers"), F.lit("splitIntoMapSets"),
    )
    return F.struct(
        over.alias("over_budget"),
        F.when(over, estimated - budget).otherwise(F.lit(0)).alias("overshoot_bytes"),
        F.when(over, F.filter(remedies, lambda x: x.isNotNull())).otherwise(
            F.array().cast("array<string>")).alias("remedies"),
    )
