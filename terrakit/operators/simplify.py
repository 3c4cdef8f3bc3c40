"""Line simplification: keep a vertex while some vertex is further than the tolerance
from the chord (as a segment) between its kept neighbours.

The work is level by level: all open chords of all lines are measured at once, the chord
with a far vertex is split there, the others are finished. Inside a task this is numpy
over one Arrow batch; for lines too long for one row the same rounds run as DataFrame
jobs until the chords are short enough. Both give the same vertices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakit.functions.shapes import segment_distance_sq
from terrakit.session import cut_lineage

#: Vertices of a line or chord in one array row. Lines that repeat a pattern are split at its
#: first repeat, one round each: in numpy 400,000 vertices of such a line take seconds.
ROW_LIMIT = 500_000


def kept_vertices(e, n, first, last, tolerance):
    """Mask over flat coordinates; ``first``/``last`` bound each line, ``tolerance`` per line."""
    keep = np.zeros(e.size, dtype=bool)
    keep[first] = keep[last] = True
    whole = tolerance <= 0
    if whole.any():
        for a, b in zip(first[whole], last[whole]):
            keep[a : b + 1] = True
    open_ = (last - first >= 2) & ~whole
    lo, hi, tol = first[open_], last[open_], tolerance[open_]
    while lo.size:
        inner = hi - lo - 1
        owner = np.repeat(np.arange(lo.size), inner)
        head = np.cumsum(inner) - inner
        k = np.arange(owner.size) - head[owner] + lo[owner] + 1
        ae, an = e[lo], n[lo]
        dx, dy = e[hi] - ae, n[hi] - an
        span = dx * dx + dy * dy
        safe = np.where(span == 0, 1.0, span)
        t = ((e[k] - ae[owner]) * dx[owner] + (n[k] - an[owner]) * dy[owner]) / safe[owner]
        t = np.where(span[owner] == 0, 0.0, np.clip(t, 0.0, 1.0))
        de, dn = e[k] - (ae[owner] + t * dx[owner]), n[k] - (an[owner] + t * dy[owner])
        d = np.sqrt(de * de + dn * dn)  # the formula of the rounds below
        top = np.maximum.reduceat(d, head)
        at = np.minimum.reduceat(np.where(d == top[owner], k, e.size), head)
        split = top > tol
        keep[at[split]] = True
        lo, hi = np.concatenate([lo[split], at[split]]), np.concatenate([at[split], hi[split]])
        tol = np.concatenate([tol[split], tol[split]])
        more = hi - lo >= 2
        lo, hi, tol = lo[more], hi[more], tol[more]
    return keep


def simplify_column(df: DataFrame, column: str, tolerance) -> DataFrame:
    """Simplify an ARRAY<STRUCT<e,n,...>> column; ``tolerance`` is a number or a column name."""
    names = df.columns
    place = names.index(column)

    def run(batches):
        for batch in batches:
            lists = batch.column(place)
            count = len(lists)
            if count == 0:
                yield batch
                continue
            offsets = lists.offsets.to_numpy().astype(np.int64)
            sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
            cells = lists.flatten()
            ends = np.cumsum(sizes)
            starts = ends - sizes
            if isinstance(tolerance, str):
                tol = batch.column(names.index(tolerance)).to_numpy(zero_copy_only=False).astype(float)
            else:
                tol = np.full(count, float(tolerance))
            some = sizes > 0
            keep = kept_vertices(
                cells.field("e").to_numpy(zero_copy_only=False),
                cells.field("n").to_numpy(zero_copy_only=False),
                starts[some], ends[some] - 1, tol[some],
            )
            total = np.concatenate([[0], np.cumsum(keep)])
            bounds = total[np.concatenate([[0], ends])].astype(np.int32)
            out = pa.ListArray.from_arrays(
                pa.array(bounds), cells.filter(pa.array(keep)), type=lists.type,
                mask=lists.is_null() if lists.null_count else None,
            )
            columns = [out if i == place else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def _by_rounds(points: DataFrame, key: str, tolerance: float, row_limit: int) -> DataFrame:
    """The same rounds as DataFrame jobs. Every open vertex carries its chord; a round is
    one partial aggregation per chord and one join with the chords that split. Chords with
    up to ``row_limit`` vertices inside leave the rounds and become one array row each."""
    c = F.col
    ends = points.groupBy(key).agg(
        F.min("i").alias("lo"), F.max("i").alias("hi"),
        F.min_by(F.struct("e", "n"), "i").alias("a"), F.max_by(F.struct("e", "n"), "i").alias("b"),
    )
    joined = points.join(ends, key)
    done = joined.filter("i = lo or i = hi").select(key, "i")
    live = cut_lineage(joined.filter("i > lo and i < hi").select(key, "i", "e", "n", "lo", "hi", "a", "b"))
    while not live.isEmpty():
        gap = F.sqrt(segment_distance_sq(c("e"), c("n"), c("a.e"), c("a.n"), c("b.e"), c("b.n")))
        best = live.groupBy(key, "lo").agg(
            F.max_by(F.struct("i", "e", "n"), F.struct(gap, -c("i"))).alias("far"), F.max(gap).alias("top")
        ).filter(c("top") > tolerance).select(key, "lo", "far")
        moved = live.join(best, [key, "lo"])
        done = done.unionByName(moved.filter("i = far.i").select(key, "i"))
        left = c("i") < c("far.i")
        at = F.struct("far.e", "far.n")
        split = cut_lineage(
            moved.filter("i <> far.i").select(
                key, "i", "e", "n",
                F.when(left, c("lo")).otherwise(c("far.i")).alias("lo"),
                F.when(left, c("far.i")).otherwise(c("hi")).alias("hi"),
                F.when(left, c("a")).otherwise(at).alias("a"),
                F.when(left, at).otherwise(c("b")).alias("b"),
            )
        )
        large = split.groupBy(key, "lo").agg(F.count(F.lit(1)).alias("inside")).filter(c("inside") > row_limit).select(key, "lo")
        chords = split.join(large, [key, "lo"], "left_anti").groupBy(key, "lo", "hi", "a", "b").agg(
            F.array_sort(F.collect_list(F.struct("i", "e", "n"))).alias("pts"))
        first, last = (F.array(F.struct(c(k).alias("i"), c(f"{v}.e").alias("e"), c(f"{v}.n").alias("n"))) for k, v in (("lo", "a"), ("hi", "b")))
        chords = chords.select(key, F.concat(first, "pts", last).alias("pts"))
        short = simplify_column(chords, "pts", tolerance).select(key, F.inline("pts")).select(key, "i")
        done = cut_lineage(done.unionByName(short))
        live = cut_lineage(split.join(large, [key, "lo"], "left_semi").select(*live.columns))
    return points.join(done, [key, "i"], "left_semi")


def simplify_points(
    points: DataFrame, key: str, tolerance: float, row_limit: int = ROW_LIMIT
) -> DataFrame:
    """Simplify lines given as (key, i, e, n). Lines up to ``row_limit`` vertices become one
    array row each; longer ones go through DataFrame rounds."""
    base = points.select(key, F.col("i").cast("bigint").alias("i"), "e", "n")
    sizes = base.groupBy(key).agg(F.count(F.lit(1)).alias("__size"))
    long_keys = sizes.filter(F.col("__size") > row_limit).select(key)
    has_long = not long_keys.isEmpty()
    short = base.join(long_keys, key, "left_anti") if has_long else base
    rows = short.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("i", "e", "n"))).alias("pts")
    )
    out = simplify_column(rows, "pts", tolerance).select(key, F.inline("pts"))
    if not has_long:
        return out
    rest = base.join(long_keys, key, "left_semi")
    return out.unionByName(_by_rounds(rest, key, tolerance, row_limit))
