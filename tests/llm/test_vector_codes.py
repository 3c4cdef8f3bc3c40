"""Vector codes against plain whole-number arithmetic."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from terrakit.llm import vector_codes as vc

KIND = "vec_id long, embedding array<float>, label int"


def plain_version(rows, parts=16, entries=64, rounds=2):
    """Codes, errors and codebooks with nothing but loops."""
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts)) * parts
    whole = [[math.floor(256 * float(np.float32(x))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    size = width // parts
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k]))[:entries]
    cut = lambda v, j: v[j * size : (j + 1) * size]
    books = [[cut(whole[k], j) for k in order] for j in range(parts)]

    def best(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for j in range(parts):
            groups = {}
            for v in whole:
                groups.setdefault(best(cut(v, j), books[j])[1], []).append(cut(v, j))
            for e, members in groups.items():
                books[j][e] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for (i, _, label), v in zip(kept, whole):
        found = [best(cut(v, j), books[j]) for j in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return out, text


def check(spark, rows):
    docs = spark.createDataFrame(rows, KIND).repartition(3).withColumns({"code": F.lit("clash"), "whole": F.lit(1)})
    coded, books = vc.vector_codes(docs)
    got = vc.with_label_errors(coded, books).collect()
    want, text = plain_version(rows)
    assert vc.codebook_text(books) == text
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in got), key=key) == sorted(want, key=key)
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    assert all(r.label_error == totals[r.label] for r in got)
    assert {r.codebooks_sha256 for r in got} <= {hashlib.sha256(text.encode()).hexdigest()}


def made(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(5)]
    return [
        (i, [c + rng.gauss(0, 0.2) for c in centres[i % 5]], rng.choice([0, 0, 0, 1, None])) for i in range(n)
    ]


def test_made_vectors(spark):
    check(spark, made(300, 32, 1))


def test_awkward(spark):
    rows = made(90, 32, 2)
    rows += [(i, list(rows[0][1]), 0) for i in range(100, 130)]  # ties
    rows += [(5, list(rows[7][1]), 1), (5, list(rows[7][1]), 1), (None, list(rows[3][1]), None)]
    rows += [(200, None, 1), (201, [None] * 32, 1), (202, [float("nan")] * 32, 1), (203, [float("inf")] * 32, 1)]
    rows += [(204, [0.0] * 32, 2), (205, [-1.5, 2.5], 2), (206, [], 2), (207, [-3000.25] * 32, 2)]
    check(spark, rows)


def test_fewer_vectors_than_entries(spark):
    check(spark, made(7, 48, 3))
    check(spark, [(1, [], 1), (2, [], None)])


def test_none_kept(spark):
    empty = spark.createDataFrame([], KIND)
    coded, books = vc.vector_codes(empty)
    assert vc.with_label_errors(coded, books).collect() == []
    coded, books = vc.vector_codes(spark.createDataFrame([(1, None, 1)], KIND))
    assert coded.collect() == [] and vc.codebook_text(books) == ""


def test_huge_components_do_not_overflow(spark):
    rows = [(i, [1e30 if i % 2 else -1e30] * 16, 0) for i in range(80)]
    coded, _ = vc.vector_codes(spark.createDataFrame(rows, KIND))
    assert {r.error for r in coded.collect()} == {0}


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(4)
    points = rng.integers(-300, 300, (4000, 4))
    book = rng.integers(-300, 300, (64, 4))
    pivots = vc.chosen_pivots(book[None])[0]
    index, best, evaluated = vc.nearest_entries(
        points, vc.distances(points, pivots), book, vc.distances(book, pivots)
    )
    all_of = ((points[:, None, :] - book[None]) ** 2).sum(2)
    assert (index == all_of.argmin(1)).all() and (best == all_of.min(1)).all()
    assert evaluated < 0.25 * all_of.size
