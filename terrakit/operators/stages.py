"""Build stages from update events, as a batch job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakit.operators.ordered import CHUNK, ranked, with_next, with_previous

c = F.col


def stage_spans(updates: DataFrame, bucket: Column, order: list[str], fine: Column | None = None) -> DataFrame:
    """(run, k, stage, since, seconds): one row per stage a run went through.

    A stage lasts from its first update to the next stage's first one; later updates of
    the same stage do not reset its clock. The last stage ends at the run's last update.
    """
    numbered = ranked(updates, ["run"], bucket, order, "i", fine=fine)
    marked = with_previous(numbered, ["run"], "i", [("stage", "before")])
    changes = marked.filter(~c("stage").eqNullSafe(c("before"))).select("run", "i", "stage", "ts")
    ordered = ranked(changes, ["run"], F.floor((c("i") - 1) / CHUNK), ["i"], "k")
    closed = with_next(ordered, ["run"], "k", [("ts", "until")])
    ends = updates.groupBy("run").agg(F.max("ts").alias("end"))
    span = closed.join(ends, "run")
    stop = F.coalesce("until", "end").cast("timestamp")
    seconds = (F.unix_micros(stop) - F.unix_micros(c("ts").cast("timestamp"))) / 1e6
    return span.select("run", "k", "stage", c("ts").alias("since"), seconds.alias("seconds"))


def stage_durations(spans: DataFrame) -> DataFrame:
    """(run, stage, seconds) summed over a run's visits to a stage."""
    return spans.groupBy("run", "stage").agg(F.sum("seconds").alias("seconds"))
