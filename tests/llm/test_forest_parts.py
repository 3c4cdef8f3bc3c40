"""Rows and queries of the forest meet once in each part, and in blocks where a dimension is large."""

from collections import defaultdict

import numpy as np
import pytest

from terrakit.llm import ann_forest

SCHEMA = "vec_id long, embedding array<double>"


def crowd(n, dim=16, seed=9):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    return [(i, (1.5 * centres[i % 12] + rng.standard_normal(dim)).tolist()) for i in range(n)]


def test_a_query_takes_one_list_from_a_part(spark, monkeypatch):
    rows = crowd(6000)
    counts, found = [], ann_forest._Forest.found

    def counted(forest, depths):
        out = found(forest, depths)
        counts.append((out.count(), depths.count(), depths.filter("depth > 0").count()))
        return out

    monkeypatch.setattr(ann_forest._Forest, "found", counted)
    ann_forest.nearest(spark.createDataFrame(rows, SCHEMA), every=60, min_candidates=100).count()
    assert any(deep for _, _, deep in counts)
    parts = min(ann_forest.ROOT_PARTS, -(-len(rows) // ann_forest.ROOT_ROWS))
    assert all(n <= asked * parts * 21 for n, asked, _ in counts)


@pytest.mark.parametrize("block_rows", [256, 65_536])
def test_blocks_and_parts_find_as_much(spark, block_rows):
    # 6,000 rows are more than 16 parts of 256, so that trees are cut into blocks; another dimension is not.
    rows = crowd(6000) + [(10_000 + i, v) for i, v in crowd(900, 12, 5)] + [(20_000 + i, v) for i, v in crowd(30, 5, 6)]
    got = defaultdict(list)
    for r in ann_forest.nearest(spark.createDataFrame(rows, SCHEMA), every=60, min_candidates=100, block_rows=block_rows).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = wanted = 0
    vectors = dict(rows)
    for q in (i for i in vectors if i % 60 == 0):
        own = np.array(vectors[q])
        scores = sorted((-float((own * np.array(v)).sum()), i) for i, v in rows if i != q and len(v) == len(own))[:20]
        assert [rank for rank, _, _ in sorted(got[q])] == list(range(1, 21))
        assert all(abs(s - float((own * np.array(vectors[i])).sum())) < 1e-9 for _, i, s in got[q])
        hits += len({i for _, i in scores} & {i for _, i, _ in got[q]})
        wanted += len(scores)
    assert hits >= 0.9 * wanted
