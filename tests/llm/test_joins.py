"""N-gram join, components, sharding, mixing, search, classifier, URL filters."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakit.llm import ann_forest, mixing, ngram_join, quality_classifier, sharding, url_filters
from terrakit.llm.components import components

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def smallest(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def plain_join(rows, k=3, percent=90):
    least = -(1 << 63)
    sets = [(least if i is None else i, n, shingles(t, k)) for n, (i, t) in enumerate(rows)]
    links = []
    for a in range(len(sets)):
        for b in range(a):
            p, q = sets[a][2], sets[b][2]
            if p and q and 100 * len(p & q) >= percent * len(p | q):
                links.append((sets[a][:2], sets[b][:2]))
    roots = smallest(links, [s[:2] for s in sets])
    out = []
    for (i, _), s in zip(rows, sets):
        c = roots[s[:2]][0]
        out.append((i, len(s[2]), i if not s[2] else None if c == least else c))
    return out


@pytest.mark.parametrize("table", ["awkward", "documents", "empty"])
@pytest.mark.parametrize("crowd", [32, 2])
def test_jaccard_components(request, table, crowd):
    docs = request.getfixturevalue(table)
    got = ngram_join.jaccard_components(docs.withColumns({"n": F.lit(0), "cls": F.lit("x")}), crowd=crowd)
    assert ordered(got.collect()) == ordered(plain_join(pairs(docs)))


def test_jaccard_components_other_settings(awkward):
    got = ngram_join.jaccard_components(awkward, words=5, percent=80, crowd=4)
    assert ordered(got.collect()) == ordered(plain_join(pairs(awkward), 5, 80))


def test_one_of_each(awkward):
    kept = ngram_join.one_of_each(awkward, 5, 80)
    groups = {(i, n): c for i, n, c in plain_join(pairs(awkward), 5, 80)}
    assert kept.columns == awkward.columns
    full = [i for i, t in pairs(kept) if WORD.search(t or "")]
    # Unlike texts of one id are groups of their own, so the id can stay more than once.
    assert sorted(full, key=repr) == sorted((i for (i, n), c in groups.items() if n and c == i), key=repr)


def test_word_hashes_tell_places_apart():
    texts = [b"ab " * 3, b"ba " * 3, b"x" * 64 + b"y" * 64, b"y" * 64 + b"x" * 64, b"a bc", b"ab c", b"a", b"a a"]
    found = [tuple(s.tolist()) for s in ngram_join.shingle_sets(texts)]
    assert len(set(found)) == len(texts)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r["node"]: r["root"] for r in got} == smallest(links, nodes) and len(got) == len(nodes)


@pytest.mark.parametrize("table", ["awkward", "documents", "empty"])
@pytest.mark.parametrize("limit", [4096, 300_000, 1 << 30])
def test_sharding(request, table, limit):
    docs = request.getfixturevalue(table)
    rows = sharding.sharded(docs.withColumn("page", F.lit("x")), limit).collect()
    assert sorted((repr(r["doc_id"]), r["n_bytes"]) for r in rows) == sorted((repr(i), len((t or "").encode())) for i, t in pairs(docs))
    sums, members = Counter(), defaultdict(list)
    for r in rows:
        assert len(r["shard"]) == r["depth"]
        sums[r["shard"], r["page"]] += r["n_bytes"]
        members[r["shard"], r["page"]].append(r)
    for place, total in sums.items():
        assert total <= limit or len(members[place]) == 1
        assert all(r["shard_bytes"] == total for r in members[place])
    whole = Counter()
    for (shard, _), total in sums.items():
        for k in range(len(shard)):
            whole[shard[:k]] += total
    assert all(total > limit for total in whole.values())  # only buckets over the limit were split
    shards = {s for s, _ in sums}
    assert not any(s != t and t.startswith(s) for s in shards for t in shards)


def plain_targets(rows):
    sums = defaultdict(int)
    for _, source, size in rows:
        sums[source] += size
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    full = {}
    while True:
        left = [s for s in names if s not in full]
        rest = 1.5 * sum(sums.values()) - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] >= 2 * sums[s]]
        if not over:
            return sums, {**full, **share}
        full |= {s: 2 * sums[s] for s in over}


@pytest.mark.parametrize("table", ["awkward", "documents", "empty"])
def test_mixing(request, table):
    docs = request.getfixturevalue(table)
    rows = mixing.mixed(docs.withColumn("size", F.lit("x"))).collect()
    again = mixing.mixed(docs.repartition(5)).collect()
    assert ordered(rows) == ordered(again)
    source = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.collect()]
    assert ordered((r["doc_id"], r["source"], r["size"]) for r in rows) == ordered(source)
    sums, targets = plain_targets(source)
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sums[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(0.03 * t, 40 if table == "documents" else 0.3 * t)


def test_mix_copies_rows(awkward):
    plan = Counter()
    for r in mixing.mixed(awkward).collect():
        plan[r["doc_id"], r["source"], r["size"]] += r["copies"]
    mixed = mixing.mix(awkward)
    assert mixed.columns == awkward.columns
    got = Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in mixed.collect())
    assert got == +plan


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain_nearest(rows, every, k):
    good = {}
    for i, v, _ in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = []
    for q in good:
        if q % every == 0:
            best = {}
            for i, vs in good.items():
                for v in vs if i != q else []:
                    for own in good[q]:
                        if len(own) == len(v):
                            best[i] = max(best.get(i, -np.inf), float((own * v).sum()))
            for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
                out.append((q, rank, i, s))
    return out


def test_forest_on_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist(), 0) for i in range(150)]
    rows += [(200 + i, [1.0] * 8, 0) for i in range(60)]  # ties
    rows += [
        (300, None, 0), (320, [], 0), (340, [0.0] * 8, 0), (360, [1.0, None] * 4, 0), (380, [float("nan")] * 8, 0),
        (400, [float("inf")] * 8, 0), (420, [3.0, 1.0], 0), (421, [1.0, 2.0], 0), (None, [1.0] * 8, 0), (60, rows[60][1], 0),
    ]
    got = ann_forest.nearest(vectors(spark, rows), block_rows=64)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = plain_nearest(rows, 20, 20)
    found = {(r[0], r[1]): r for r in map(tuple, got.collect())}
    assert len(found) == got.count() == len(want)
    hits = sum((q, i) in {(f[0], f[2]) for f in found.values()} for q, _, i, _ in want)
    assert hits >= 0.95 * len(want)
    for q, rank, i, s in want:
        if q in (200, 220, 240, 420):
            assert found[q, rank][2] == i and abs(found[q, rank][3] - s) < 1e-6


def test_forest_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    got = {(r["query_id"], r["vec_id"]) for r in ann_forest.nearest(table, min_candidates=1500).collect()}
    want = {(q, i) for q, _, i, _ in plain_nearest(rows, 20, 20)}
    assert len(got & want) >= 0.9 * len(want)


def test_forest_empty(spark):
    assert ann_forest.nearest(vectors(spark, [])).count() == 0
    assert ann_forest.nearest(vectors(spark, [(0, [1.0, 2.0], 1)])).count() == 0


def test_classifier(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality_classifier.classified(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_classifier_awkward(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_classifier.classified(awkward, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 5, 0), (101, 1, 1), (101, 1, 1), (99999, 0, 0)], none.schema)
    assert quality_classifier.classified(awkward, odd).count() == awkward.count()
    assert quality_classifier.classified(empty, odd).count() == 0


def test_flat_trees_agree_with_a_walk():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = quality_classifier.fit_trees(x, y, trees=30)
    found = quality_classifier.scores(model, x)
    for row, score in zip(x[:50], found[:50]):
        total = model["base"][0]
        for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"]):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-12
    assert ((found > 0.5) == y).mean() > 0.95


def test_url_filters(spark):
    rng = random.Random(1)
    domains = ["com", "a.com", "b.com", "x.a.com", "y.x.a.com", "b.org"]
    entries = [(rng.choice(domains), rng.choice(["allow", "block"]), rng.randrange(200), rng.choice(["add", "remove"])) for _ in range(60)]
    entries += [(None, "block", 1, "add"), ("a.com", None, 1, "add"), ("a.com", "block", None, "add")]
    urls = [f"http://{d}/p" for d in domains] + ["https://u@Y.X.A.com:80/q?x", None, "", "nonsense", "http:///x", "http://c.net#y"]
    captures = [(n, rng.choice(urls), rng.choice([None, *range(210)]), "old") for n in range(400)]
    captures += captures[:5]
    frame = spark.createDataFrame(captures, "page_id long, url string, day long, verdict string")
    listed = spark.createDataFrame(entries, "domain string, list string, day long, action string")

    def active(domain, name, day):
        past = [(d, a) for e, n, d, a in entries if e == domain and n == name and d is not None and d <= day]
        last = [a for d, a in past if d == max(x for x, _ in past)]
        return bool(last) and "remove" not in last

    def judge(url, day):
        m = re.match(r"[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#]+)", url or "")
        if m and day is not None:
            labels = m[1].lower().split(".")
            for k in range(len(labels)):
                for name in ("allow", "block"):
                    if active(".".join(labels[k:]), name, day):
                        return name, ".".join(labels[k:])
        return "none", None

    got = url_filters.judged_captures(frame, listed).select("page_id", "verdict", "matched").collect()
    assert ordered(got) == ordered((p, *judge(u, d)) for p, u, d, _ in captures)
    assert url_filters.judged_captures(frame.limit(0), listed).count() == 0
    assert {r["verdict"] for r in url_filters.judged_captures(frame, listed.limit(0)).collect()} == {"none"}


@pytest.mark.parametrize("block_rows", [65_536, 512])
def test_forest_recall_where_prefixes_are_used(spark, block_rows):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (1.5 * centres[i % 12] + rng.standard_normal(16)).tolist(), 0) for i in range(6000)]
    got = {(r["query_id"], r["vec_id"]) for r in ann_forest.nearest(
        vectors(spark, rows), every=60, min_candidates=100, block_rows=block_rows).collect()}
    want = {(q, i) for q, _, i, _ in plain_nearest_fast(rows, 60, 20)}
    assert len(got & want) >= 0.9 * len(want)


def plain_nearest_fast(rows, every, k):
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    for q in range(0, len(rows), every):
        score = v @ v[q]
        score[q] = -np.inf
        for rank, i in enumerate(np.lexsort([np.arange(len(rows)), -score])[:k], 1):
            yield q, rank, int(i), score[i]


def test_forest_widens_outliers_and_small_dimensions(spark):
    rng = np.random.default_rng(3)
    centre = 5 * rng.standard_normal(8)
    rows = [(i, (centre + 0.05 * rng.standard_normal(8)).tolist(), 0) for i in range(1, 4000)]
    rows.append((0, (-3 * centre).tolist(), 0))
    rows += [(5000 + i, rng.standard_normal(6).tolist(), 0) for i in range(30)]
    got = defaultdict(list)
    for r in ann_forest.nearest(vectors(spark, rows), min_candidates=600, block_rows=512).collect():
        got[r["query_id"]].append(r["vec_id"])
    assert len(got) == 202 and all(len(ids) == 20 for ids in got.values())
    want = defaultdict(list)
    for q, _, i, _ in plain_nearest([r for r in rows if r[0] >= 5000], 20, 20):
        want[q].append(i)
    assert all(sorted(got[q]) == sorted(ids) for q, ids in want.items())


def test_one_of_each_keeps_unlike_texts_of_an_id(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(60)) for _ in range(7)]
    rows = [(None, texts[n]) for n in range(4)] + [(None, texts[0])]
    rows += [(3, texts[4]), (7, texts[4] + " tail"), (7, texts[5]), (7, texts[6]), (9, texts[6]), (None, ""), (7, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = pairs(ngram_join.one_of_each(docs, 5, 80))
    want = [(None, texts[n]) for n in range(4)] + [(3, texts[4]), (7, texts[5]), (7, texts[6]), (None, ""), (7, " ")]
    assert ordered(kept) == ordered(want)


def test_forest_strings_against_a_loop():
    rng = np.random.default_rng(2)
    projected = rng.standard_normal((6, 3, sum(ann_forest.AXES)))
    codes, asking = ann_forest._strings(projected)
    for row in range(6):
        for tree in range(3):
            at, symbols = 0, []
            for axes in ann_forest.AXES:
                signed = {2 * a + s: (1 if s else -1) * projected[row, tree, at + a] for a in range(axes) for s in (0, 1)}
                symbols.append(sorted(signed, key=lambda x: -signed[x]))
                at += axes
            for probe in range(ann_forest.PROBES):
                want = symbols[0][probe]
                for width, ordered_symbols in zip(ann_forest.WIDTHS[1:], symbols[1:]):
                    want = want * 2**width + ordered_symbols[0]
                assert asking[row, probe * 3 + tree] == want
            assert codes[row, tree] == asking[row, tree]
    some = np.sort(codes[:, 0])
    for left in ann_forest.LEFT:
        low, high = ann_forest._ends(some, codes[:, 0], np.int64(left))
        for code, a, b in zip(codes[:, 0], low, high):
            assert b - a == sum(int(x) >> left == int(code) >> left for x in some)


def test_forest_lists_stay_full_where_ranges_hold_too_little(spark):
    # A query far from a tight crowd shares strings with nothing; copies of one row fill no list.
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(12)[0] * 4 + 0.01 * rng.standard_normal(12)).tolist(), 0) for i in range(1, 900)]
    rows += [(0, (-np.eye(12)[0] * 4).tolist(), 0)] + [(2000 + i, np.eye(12)[3].tolist(), 0) for i in range(5)]
    got = defaultdict(list)
    for r in ann_forest.nearest(vectors(spark, rows), every=100).collect():
        got[r["query_id"]].append(r["rank"])
    assert set(got) == {q for q, _, _ in rows if q % 100 == 0}
    assert all(sorted(ranks) == list(range(1, 21)) for ranks in got.values())
