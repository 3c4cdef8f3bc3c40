"""Geometry held in one row: a ring or line is ``ARRAY<STRUCT<e:DOUBLE,n:DOUBLE>>``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<e:double,n:double>>"
EMPTY = "CAST(array() AS array<struct<e:double,n:double>>)"


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def point(e: Column, n: Column) -> Column:
    return F.struct(e.cast("double").alias("e"), n.cast("double").alias("n"))


def edges(ring: Column) -> Column:
    """ARRAY of {a, b} for every edge, the closing one included."""
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
    return F.zip_with(ring, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def bounds(points: Column) -> Column:
    """{min_e, min_n, max_e, max_n}; null for an empty array."""
    es = F.transform(points, lambda p: p["e"])
    ns = F.transform(points, lambda p: p["n"])
    return F.when(
        F.size(points) > 0,
        F.struct(
            F.array_min(es).alias("min_e"), F.array_min(ns).alias("min_n"),
            F.array_max(es).alias("max_e"), F.array_max(ns).alias("max_n"),
        ),
    )


def _sum(items: Column, fn) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + fn(x))


def _cross(x) -> Column:
    return x["a"]["e"] * x["b"]["n"] - x["b"]["e"] * x["a"]["n"]


def signed_area(ring: Column) -> Column:
    """Positive for counter-clockwise rings."""
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(_sum(edges(ring), _cross) / 2.0)


def polygon_area(rings: Column) -> Column:
    """Exterior minus holes, never below zero. ``rings`` has the exterior first."""
    sizes = F.transform(rings, lambda r: F.abs(signed_area(r)))
    total = F.aggregate(sizes, F.lit(0.0), lambda acc, x: acc + x)
    return F.greatest(2.0 * F.coalesce(F.try_element_at(sizes, F.lit(1)), F.lit(0.0)) - total, F.lit(0.0))


def centroid(ring: Column) -> Column:
    """Area centroid; the mean of the vertices where the area is zero."""
    def solve(es):
        doubled = _sum(es, _cross)
        e = _sum(es, lambda x: (x["a"]["e"] + x["b"]["e"]) * _cross(x))
        n = _sum(es, lambda x: (x["a"]["n"] + x["b"]["n"]) * _cross(x))
        count = F.size(es).cast("double")
        flat = F.abs(doubled) < 2.220446049250313e-16
        safe = F.when(flat, F.lit(1.0)).otherwise(doubled)
        return F.struct(
            F.when(flat, _sum(es, lambda x: x["a"]["e"]) / count).otherwise(e / (3.0 * safe)).alias("e"),
            F.when(flat, _sum(es, lambda x: x["a"]["n"]) / count).otherwise(n / (3.0 * safe)).alias("n"),
        )

    return F.when(F.size(ring) >= 3, let(edges(ring), solve))


def crosses(e: Column, n: Column, ae, an, be, bn) -> Column:
    """The eastward ray from (e, n) crosses the edge a-b."""
    straddles = (an > n) != (bn > n)
    rise = F.when(bn == an, F.lit(1.0)).otherwise(bn - an)
    return straddles & (e < (be - ae) * (n - an) / rise + ae)


def in_ring(e: Column, n: Column, ring: Column) -> Column:
    # An edge runs from the previous vertex (b) to the current one (a).
    hits = F.filter(
        edges(ring), lambda x: crosses(e, n, x["b"]["e"], x["b"]["n"], x["a"]["e"], x["a"]["n"])
    )
    return F.size(hits) % 2 == 1


def in_polygon(e: Column, n: Column, rings: Column) -> Column:
    """In the exterior and in no hole."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1)))
    return (
        (F.size(rings) > 0)
        & F.coalesce(in_ring(e, n, F.try_element_at(rings, F.lit(1))), F.lit(False))
        & ~F.exists(holes, lambda h: in_ring(e, n, h))
    )


def closed(points: Column) -> Column:
    """The ring with its first point repeated at the end unless it already is."""
    first, last = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    return F.when(first == last, points).when(F.size(points) > 0, F.concat(points, F.array(first))).otherwise(points)


def circle(e: Column, n: Column, radius: Column, corners: int = 64) -> Column:
    """A closed regular polygon, starting due east, counter-clockwise."""
    angle = lambda i: i.cast("double") * (2.0 * math.pi / corners)
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(corners - 1)),
        lambda i: point(e + radius * F.cos(angle(i)), n + radius * F.sin(angle(i))),
    )
    return closed(ring)


def length(points: Column) -> Column:
    """Length of an open line."""
    pairs = F.slice(edges(points), 1, F.greatest(F.size(points) - 1, F.lit(0)))
    return _sum(pairs, lambda x: F.hypot(x["b"]["e"] - x["a"]["e"], x["b"]["n"] - x["a"]["n"]))


def segment_distance_sq(e, n, ae, an, be, bn) -> Column:
    """Squared distance to the segment a-b; a zero-length segment is a point."""
    dx, dy = be - ae, bn - an
    span = dx * dx + dy * dy
    share = ((e - ae) * dx + (n - an) * dy) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    at = F.when(span == 0, F.lit(0.0)).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    de, dn = e - (ae + at * dx), n - (an + at * dy)
    return de * de + dn * dn


def clip_span(ae, an, be, bn, min_e, min_n, max_e, max_n) -> Column:
    """{t0, t1} of the part of a-b inside the box, null when nothing is.

    The entering parameter is the largest lower bound over the four sides, the leaving
    one the smallest upper bound; a side parallel to the segment only decides in or out.
    """
    dx, dy = be - ae, bn - an
    sides = [(-dx, ae - min_e), (dx, max_e - ae), (-dy, an - min_n), (dy, max_n - an)]
    enter, leave, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in sides:
        cut = q / F.when(p == 0, F.lit(1.0)).otherwise(p)
        enter = F.greatest(enter, F.when(p < 0, cut).otherwise(F.lit(0.0)))
        leave = F.least(leave, F.when(p > 0, cut).otherwise(F.lit(1.0)))
        out = out | ((p == 0) & (q < 0))
    both = let(
        F.struct(enter.alias("t0"), leave.alias("t1")),
        lambda s: F.when(~out & (s["t0"] <= s["t1"]), s),
    )
    return both


def clip_line(points: Column, min_e, min_n, max_e, max_n) -> Column:
    """ARRAY of parts. Consecutive clipped segments share a part while the end of one is
    exactly the start of the next."""
    none = F.expr(f"named_struct('parts', CAST(array() AS array<{POINTS}>), 'run', {EMPTY})")

    def step(acc, x):
        a, b = x["a"], x["b"]
        span = clip_span(a["e"], a["n"], b["e"], b["n"], min_e, min_n, max_e, max_n)

        def grow(s):
            dx, dy = b["e"] - a["e"], b["n"] - a["n"]
            start = point(a["e"] + s["t0"] * dx, a["n"] + s["t0"] * dy)
            end = point(a["e"] + s["t1"] * dx, a["n"] + s["t1"] * dy)
            joins = F.coalesce(F.try_element_at(acc["run"], F.lit(-1)) == start, F.lit(False))
            flushed = F.when(F.size(acc["run"]) > 1, F.concat(acc["parts"], F.array(acc["run"]))).otherwise(acc["parts"])
            return (
                F.when(s.isNull(), F.struct(flushed.alias("parts"), F.expr(EMPTY).alias("run")))
                .when(joins, F.struct(acc["parts"].alias("parts"), F.concat(acc["run"], F.array(end)).alias("run")))
                .otherwise(F.struct(flushed.alias("parts"), F.array(start, end).alias("run")))
            )

        return let(span, grow)

    pairs = F.slice(edges(points), 1, F.greatest(F.size(points) - 1, F.lit(0)))
    return F.aggregate(
        pairs, none, step,
        lambda s: F.when(F.size(s["run"]) > 1, F.concat(s["parts"], F.array(s["run"]))).otherwise(s["parts"]),
    )


def _clip_half(ring: Column, keep, cut) -> Column:
    """One side of the box: walk the edges, keep inside vertices, add crossings."""
    previous = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))
    pairs = F.zip_with(previous, ring, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def emit(x):
        a, b = x["a"], x["b"]
        return (
            F.when(keep(b) & keep(a), F.array(b))
            .when(keep(b), F.array(cut(a, b), b))
            .when(keep(a), F.array(cut(a, b)))
            .otherwise(F.expr(EMPTY))
        )

    return F.flatten(F.transform(pairs, emit))


def _half_plane(keep, cut):
    return lambda ring: _clip_half(ring, keep, cut)


def clip_ring(ring: Column, min_e, min_n, max_e, max_n) -> Column:
    """The closed ring cut to the box; empty when fewer than three points remain."""
    def at_e(v):
        return lambda a, b: point(F.lit(0.0) + v, a["n"] + (b["n"] - a["n"]) * (v - a["e"]) / (b["e"] - a["e"]))

    def at_n(v):
        return lambda a, b: point(a["e"] + (b["e"] - a["e"]) * (v - a["n"]) / (b["n"] - a["n"]), F.lit(0.0) + v)

    sides = [
        (lambda p: p["e"] >= min_e, at_e(min_e)), (lambda p: p["e"] <= max_e, at_e(max_e)),
        (lambda p: p["n"] >= min_n, at_n(min_n)), (lambda p: p["n"] <= max_n, at_n(max_n)),
    ]
    doubled = (F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1))) & (F.size(ring) > 1)
    work = F.when(doubled, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)
    for keep, cut in sides:
        work = let(work, _half_plane(keep, cut))
    return let(work, lambda r: F.when(F.size(r) >= 3, F.concat(r, F.slice(r, 1, 1))).otherwise(F.expr(EMPTY)))


def clip_parts(kind: Column, parts: Column, min_e, min_n, max_e, max_n) -> Column:
    """Clip a geometry given as parts {poly, ring, pts}; points are one-point parts.

    Lines split into more parts; rings keep their place unless fewer than four points
    remain. An empty result means nothing of the geometry is inside.
    """
    box = (min_e, min_n, max_e, max_n)

    def one(p):
        def with_points(pts):
            return F.struct(p["poly"].alias("poly"), p["ring"].alias("ring"), pts.alias("pts"))

        inside = F.filter(
            p["pts"], lambda c: (c["e"] >= min_e) & (c["e"] <= max_e) & (c["n"] >= min_n) & (c["n"] <= max_n)
        )
        return (
            F.when(kind.endswith("Polygon"), let(
                clip_ring(p["pts"], *box), lambda r: F.filter(F.array(with_points(r)), lambda x: F.size(x["pts"]) >= 4)))
            .when(kind.endswith("LineString"), F.transform(clip_line(p["pts"], *box), with_points))
            .otherwise(F.filter(F.array(with_points(inside)), lambda x: F.size(x["pts"]) > 0))
        )

    return F.flatten(F.transform(parts, one))


def clipped_kind(kind: Column, parts: Column) -> Column:
    """A line cut into several parts becomes a multi-line."""
    return F.when((kind == "LineString") & (F.size(parts) > 1), "MultiLineString").otherwise(kind)


def e7(degrees: Column) -> Column:
    """Fixed-point degrees, 1e-7."""
    return F.round(degrees * 1e7).cast("int")


def without_repeats(values: Column) -> Column:
    """Consecutive equal values collapse to one; a null is kept."""
    steps = F.greatest(F.size(values) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(values, 1, steps), F.slice(values, 2, steps), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    changes = F.filter(pairs, lambda x: ~F.coalesce(x["a"] == x["b"], F.lit(False)))
    return F.concat(F.slice(values, 1, 1), F.transform(changes, lambda x: x["b"]))
