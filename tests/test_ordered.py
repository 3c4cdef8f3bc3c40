"""Ordered operators with small chunks and one key that holds most rows."""

import random

from pyspark.sql import functions as F

from terrakit.operators import lines, ordered

c = F.col


def rows(size=500):
    rng = random.Random(3)
    keys = [1] * (size // 2) + [rng.randrange(2, 6) for _ in range(size // 2)]
    return [(k, rng.random(), rng.randrange(100)) for k in keys]


def by_key(data):
    out = {}
    for k, t, v in sorted(data):
        out.setdefault(k, []).append((t, v))
    return out


def test_ranked_and_neighbours(spark):
    data = rows()
    df = spark.createDataFrame(data, "k int, t double, v long")
    r = ordered.ranked(df, ["k"], F.floor(c("t") * 20), ["t"], "i")
    p = ordered.with_previous(r, ["k"], "i", [("v", "p1"), ("v", "p3", 3)], chunk=8).drop("chunk")
    p = ordered.with_next(p, ["k"], "i", [("v", "n1")], chunk=8).drop("chunk")
    p = ordered.running_total(p, ["k"], "i", c("v"), "total", chunk=8)
    got = {(x.k, x.i): x for x in p.collect()}
    assert len(got) == len(data)
    for k, seq in by_key(data).items():
        total = 0
        for i, (t, v) in enumerate(seq, 1):
            x = got[(k, i)]
            total += v
            assert (x.t, x.v, x.total) == (t, v, total)
            assert x.p1 == (seq[i - 2][1] if i > 1 else None)
            assert x.p3 == (seq[i - 4][1] if i > 3 else None)
            assert x.n1 == (seq[i][1] if i < len(seq) else None)


def test_crowded_buckets_are_cut_finer(spark):
    data = rows()
    df = spark.createDataFrame(data, "k int, t double, v long")
    got = ordered.ranked(df, ["k"], F.floor(c("t") * 3), ["t"], "i", fine=F.floor(c("t") * 200), crowd=20).collect()
    assert {(r.k, r.t): r.i for r in got} == {(k, t): i for k, seq in by_key(data).items() for i, (t, _) in enumerate(seq, 1)}


def test_ranked_without_key(spark):
    df = spark.createDataFrame([(x,) for x in range(100, 0, -1)], "x int")
    got = ordered.ranked(df, [], F.floor(c("x") / 7), ["x"], "i").collect()
    assert all(r.x == r.i for r in got)


def test_clip_segments_agrees_with_rows(spark):
    from terrakit.functions import shapes

    rng = random.Random(1)
    track = [(float(rng.randrange(0, 30)), float(rng.randrange(0, 30))) for _ in range(200)]
    points = spark.createDataFrame([(1, i, e, n) for i, (e, n) in enumerate(track, 1)], "k int, i int, e double, n double")
    seg = lines.clip_segments(points, "k", 5, 5, 20, 20)
    want = spark.createDataFrame([(track,)], "pts array<struct<e:double,n:double>>").select(
        shapes.clip_line(c("pts"), *[F.lit(v) for v in (5.0, 5.0, 20.0, 20.0)]).alias("p")).first()["p"]
    sizes = [r.m + 1 for r in seg.groupBy("part").agg(F.count("*").alias("m")).orderBy("part").collect()]
    assert sizes == [len(p) for p in want]


def test_ascent_skips_missing(spark):
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate([100.0, None, 110.0, 105.0, None, 120.0], 1)], "k int, i int, ele double")
    assert lines.ascents(df, "k").first()["ascent_m"] == 25.0
