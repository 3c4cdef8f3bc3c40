"""Streams over the events and samples, run with an available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrakit.queries.aggregates import SPANS
from terrakit.queries.planning import PLAIN, plain_samples
from terrakit.registry import query
from terrakit.session import shared_path
from terrakit.streaming import calibration, stage_clock

c = F.col

TRIGGER_BYTES = str(128 << 20)


def updates(t):
    """The events as a stream of build updates, a bounded size per trigger: with a number of
    files instead, triggers grow with the files, and each writes the states it meets anew."""
    schema = t.events.schema
    raw = (t.spark.readStream.schema(schema).option("maxBytesPerTrigger", TRIGGER_BYTES)
           .parquet(f"{t.sf_dir}/events.parque[t]"))  # a pattern may be a file or a folder, a plain path a folder only
    return raw.select(c("user_id").alias("run"), c("event_type").alias("stage"), "ts", "event_id")


def whole_span(t):
    """A lateness that no update exceeds, whatever order the files are in."""
    us = F.unix_micros(c("ts").cast("timestamp"))
    span = t.events.agg((F.max(us) - F.min(us)).alias("us")).first()["us"]
    return f"{(span or 0) // 1_000_000 + 1} seconds"


def run(t, operator, label):
    lateness = whole_span(t)
    return stage_clock.replay(updates(t), lambda stream: operator(stream, lateness=lateness), shared_path(t.spark, label))


def shown(stream, lateness):
    return stage_clock.throttled(stream, interval_us=6 * 3600 * 1_000_000, lateness=lateness)


@query("l1_stage_clock", "L1", uses="b_updates", sql=SPANS + """
    , z as (select *, max(k) over (partition by run) last from sp) select run, k, stage, round(seconds,6) as seconds from z where k<last""")
def _(t):
    return run(t, stage_clock.stage_spans, "clock").select("run", "k", "stage", F.round("seconds", 6).alias("seconds"))


@query("l2_calibration_feed", "L2 E18", uses="b_samples", sql=f"""
    with {PLAIN}, ij as (select i, j from range(11) a(i) cross join range(11) b(j) where i<=j)
    select cast(i as int) i, cast(j as int) j, sum(v[i+1]*v[j+1]) v from x cross join ij group by i, j
    union all select cast(i as int), -1, sum(v[i+1]*y) from x cross join range(11) a(i) group by i""")
def _(t):
    base = shared_path(t.spark, "feed")
    samples = plain_samples(t)
    samples.repartition(4).write.json(f"{base}/in")
    stream = t.spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 2).json(f"{base}/in")
    calibration.follow(stream, f"{base}/sums", f"{base}/checkpoint").awaitTermination()
    return calibration.total_sums(t.spark, f"{base}/sums")


@query("l3_progress_throttle", "L3", uses="b_updates", sql="""
    with u as (select run, stage, ts, event_id, lag(stage) over (partition by run order by ts, event_id) p from b_updates)
    select run, count(*) changes from u where p is null or p<>stage group by run""")
def _(t):
    return run(t, shown, "throttle").filter("changed").groupBy("run").agg(F.count(F.lit(1)).alias("changes"))


@query("l3_shown_updates", "L3")
def _(t):
    return run(t, shown, "throttle")
