"""Build updates as streams: stage durations and a progress throttle.

Updates may come in any order and in any trigger. Each run's updates wait in state until
the watermark has passed them and are looked at in time order then, so the result does
not depend on how the source deals them out. ``lateness`` is how far an update may come
behind the latest one seen; the engine drops what comes later still and counts it in the
progress of the query. Runs are dealt out to ``buckets`` states, as the engine takes some
milliseconds for a state whatever it holds; a state holds its runs' updates of one
lateness at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINISHED = "finished"
SPANS = "run long, k long, stage string, since timestamp, until timestamp, seconds double"
WAITING = "runs array<long>, us array<long>, pos array<long>, names array<string>, clocked array<long>, "
CLOCK = WAITING + "k array<long>, stage array<string>, since array<long>"
PROGRESS = "run long, stage string, ts timestamp, changed boolean"
THROTTLE = WAITING + "stage array<string>, shown array<long>"
BUCKETS = 1024
INTERVAL_US = 250_000
LATENESS = "1 hour"
LAST = np.iinfo(np.int64).max

#: Event time of the row that ends a replay; later than any update.
CLOSING = "2190-01-01"

#: The engine's watermark starts at 1970; 70 years are added so that updates of that time
#: and before are not late.
SHIFT_US = 70 * 365 * 86_400 * 1_000_000


def _time(us: int) -> np.datetime64:
    return np.datetime64(us - SHIFT_US, "us")


def _table(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _places(pos: pd.Series) -> np.ndarray:
    """Event numbers; updates without one come last at their time."""
    values = pos.to_numpy()
    if values.dtype == np.int64:
        return values
    none = pd.isna(values)
    out = np.full(len(values), LAST)
    out[~none] = values[~none].astype(np.int64)
    return out


def _by_bucket(key, frames, state: GroupState, step, schema: str):
    """Put each run's updates that the watermark has passed, in time order, through
    ``step(run, clock, us, names)``, which gives rows and the run's new clock, or none."""
    watermark = state.getCurrentWatermarkMs()
    *waiting, clocked = state.get[:5] if state.exists else ([], [], [], [], [])
    clocks = dict(zip(clocked, zip(*state.get[5:]))) if clocked else {}
    parts = [[np.array(v, object if at == 3 else np.int64) for at, v in enumerate(waiting)]]
    parts += [[f["run"].to_numpy(np.int64), f["us"].to_numpy(np.int64), _places(f["pos"]), f["stage"].to_numpy(object)]
              for f in frames if len(f)]
    runs, us, pos, names = (np.concatenate(column) for column in zip(*parts))
    due = us <= watermark * 1000
    waiting = [v[~due] for v in (runs, us, pos, names)]
    runs, us, pos, names = (v[due] for v in (runs, us, pos, names))
    order = np.lexsort((pos, us, runs))
    runs, us, names = runs[order], us[order], names[order]
    starts = np.flatnonzero(np.diff(runs, prepend=runs[:1] - 1))
    rows = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(runs)]):
        run = int(runs[a])
        made, clock = step(None if key[0] < 0 else run, clocks.pop(run, None), us[a:b], names[a:b])
        rows += made
        if clock is not None:
            clocks[run] = clock
    if clocks or len(waiting[1]):
        own = list(zip(*clocks.values())) or [()] * (schema[1].count(",") - 4)
        state.update((*(v.tolist() for v in waiting), list(clocks), *(list(v) for v in own)))
        if len(waiting[1]):
            state.setTimeoutTimestamp(max(int(waiting[1].min()) // 1000, watermark) + 1)
    elif state.exists:
        state.remove()
    if rows:
        yield _table(rows, schema[0])


def _changes(names: np.ndarray, stage: str | None) -> np.ndarray:
    """Places where the stage is not the one before; ``stage`` comes before the first."""
    before = np.concatenate([np.array([stage], object), names[:-1]]) if len(names) else names
    return np.flatnonzero(names != before)


def _spans(run, clock, us: np.ndarray, names: np.ndarray):
    k, stage, since = clock or (0, None, 0)
    rows = []
    for at in _changes(names, stage).tolist():
        now = int(us[at])
        if stage is not None:
            rows.append((run, k, stage, _time(since), _time(now), (now - since) / 1e6))
        # What follows the end of a run starts its clock anew.
        k, stage, since = (0, None, 0) if names[at] == FINISHED else (k + 1, names[at], now)
    return rows, None if stage is None else (k, stage, since)


def _micros(updates: DataFrame, lateness: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp")) + SHIFT_US
    stream = updates.withColumn("clock", F.timestamp_micros(us)).withWatermark("clock", lateness)
    return stream.select("run", "stage", "clock", us.alias("us"), F.col("event_id").alias("pos"))


def _bucketed(updates: DataFrame, lateness: str, step, rows: str, state: str, buckets: int) -> DataFrame:
    # Updates of no run are a bucket of their own.
    bucket = F.when(F.col("run").isNull(), -1).otherwise(F.pmod(F.xxhash64("run"), F.lit(buckets)).cast("int"))
    stream = _micros(updates, lateness).withColumn("bucket", bucket).withColumn("run", F.coalesce("run", F.lit(0)).cast("bigint"))

    def each(key, frames, group):
        yield from _by_bucket(key, frames, group, step, (rows, state))

    return stream.groupBy("bucket").applyInPandasWithState(each, rows, state, "append", GroupStateTimeout.EventTimeTimeout)


def stage_spans(updates: DataFrame, lateness: str = LATENESS, buckets: int = BUCKETS) -> DataFrame:
    """Closed stages of a stream of updates (run, stage, ts, event_id).

    A stage closes when another one starts; an update of stage ``finished`` closes the
    last one and frees the run's state. The batch form is operators.stages.stage_spans.
    """
    return _bucketed(updates, lateness, _spans, SPANS, CLOCK, buckets)


def _shown(run, clock, us: np.ndarray, names: np.ndarray, interval: int):
    stage, shown = clock or (None, 0)
    changes = _changes(names, stage)
    rows, at = [], 0
    while at < len(us):
        ahead = int(np.searchsorted(changes, at))
        changed = int(changes[ahead]) if ahead < len(changes) else len(us)
        due = max(at, int(np.searchsorted(us, shown + interval)))
        at = min(changed, due)
        if at == len(us):
            break
        shown = int(us[at])
        rows.append((run, names[at], _time(shown), at == changed))
        at += 1
    return rows, (names[-1], shown)


def throttled(
    updates: DataFrame, interval_us: int = INTERVAL_US, lateness: str = LATENESS, buckets: int = BUCKETS
) -> DataFrame:
    """Updates worth showing: every stage change, and progress inside a stage at most once
    per interval since the last row shown."""
    def step(run, clock, us, names):
        return _shown(run, clock, us, names, interval_us)

    return _bucketed(updates, lateness, step, PROGRESS, THROTTLE, buckets)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what the source holds now, to Parquet, and read the result back."""
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def replay(updates: DataFrame, operator, base: str) -> DataFrame:
    """Everything that ``operator`` makes of what the source holds now, to its end.

    A second source below ``base`` is empty at first. When the updates are through, it
    gets one row of no run that lies far behind them in time; the watermark follows it
    and passes all updates that still wait.
    """
    spark = updates.sparkSession
    updates = updates.withColumn("ts", F.col("ts").cast("timestamp"))
    end = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in updates.schema])
    end = end.withColumn("ts", F.lit(CLOSING).cast("timestamp"))
    end.limit(0).write.parquet(f"{base}/end")
    stream = operator(updates.unionByName(spark.readStream.schema(end.schema).parquet(f"{base}/end")))
    run_available(stream, f"{base}/out", f"{base}/checkpoint")
    end.write.mode("append").parquet(f"{base}/end")
    return run_available(stream, f"{base}/out", f"{base}/checkpoint")
