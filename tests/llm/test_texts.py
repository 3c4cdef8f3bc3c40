"""Line dedup, quality rules, license scan and packing against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakit.llm import license_scan, line_dedup, packing, quality_rules
from terrakit.llm.queries import default_tokenizer

BLANK = " \t\n\x0b\x0c\r"
LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def plain_dedup(rows):
    def key(line):
        return line.strip(BLANK).translate(LOWER)

    least = -(1 << 63)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(least if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = least if i is None else i
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("table", ["awkward", "documents", "empty"])
def test_line_dedup(request, table):
    docs = request.getfixturevalue(table)
    found = line_dedup.drop_repeated_lines(docs)
    assert set(docs.columns) < set(found.columns)
    got = found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert ordered(got) == ordered(plain_dedup(pairs(docs)))


def test_line_dedup_keeps_clashing_columns(awkward):
    clash = awkward.withColumns({"pos": F.lit(1), "h1": F.lit("x"), "line": F.lit(2), "keeper": F.lit(3), "n_lines": F.lit("old")})
    found = line_dedup.drop_repeated_lines(clash)
    assert found.filter("pos = 1 and h1 = 'x' and line = 2 and keeper = 3").count() == awkward.count()


def plain_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


@pytest.mark.parametrize("table", ["awkward", "documents", "empty"])
def test_quality_statistics(request, table):
    docs = request.getfixturevalue(table)
    got = quality_rules.judged(docs.withColumns({"kept": F.lit(0), "n_words": F.lit("x")}))
    rows = got.select("doc_id", *quality_rules.STATS[:5], "base_failed").collect()
    assert ordered(rows) == ordered([(i, *plain_rules(t)) for i, t in pairs(docs)])
    assert got.filter("base_failed and kept").count() == 0


def test_quality_verdicts_follow_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality_rules.judged(documents).join(labels, "doc_id").select("quality", "kept", "n_words").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and r["n_words"] >= 20]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert all(good) and sum(bad) <= 0.1 * len(bad)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    right = [0.9, 0.8, 0.7, 0.95, 0.85, 0.6, 0.9, 0.75, 0.8]
    votes = np.stack([np.where(rng.random(len(truth)) < a, truth, ~truth) * 2 - 1 for a in right], 1)
    votes[rng.random(votes.shape) < 0.3] = 0
    share, table = quality_rules.fit_label_model(list(Counter(map(tuple, votes.tolist())).items()))
    assert abs(share - 0.7) < 0.03
    for a, t in zip(right, table):
        assert abs(t[1][0] / (t[1][0] + t[-1][0]) - a) < 0.05


def test_keep_good_keeps_rows_whole(awkward):
    kept = quality_rules.keep_good(awkward)
    assert kept.columns == awkward.columns
    verdicts = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality_rules.judged(awkward).collect()}
    assert kept.count() == sum(verdicts[i, plain_rules(t)[0]] for i, t in pairs(awkward))


def plain_scan(text, scanner):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    matches, score = [], 1.0 if starts else 0.0
    for label, notice, marks in license_scan.NOTICES:
        t = [w.decode() for w in license_scan.words(notice.encode())]
        needed = -(-len(set(t)) * 8 // 10)
        for at in range(0, max(1, len(words)), len(t)):
            block = words[at : at + 2 * len(t)]
            shared = len(set(t) & set(block))
            said = " " + " ".join(block) + " "
            if shared >= needed and all(any(f" {m} " in said for m in group) for group in marks):
                score = max(score, shared / len(set(t)))
                matches += [(at + i, shared, label) for m in marks[0] for i in range(len(block)) if block[i : i + len(m.split())] == m.split()]
    more = {label for at, n, label in matches if n == max(k for place, k, _ in matches if place == at)}
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | more)), score,
    )


@pytest.mark.parametrize("table", ["awkward", "documents", "empty"])
def test_license_scan(request, table):
    docs = request.getfixturevalue(table)
    got = license_scan.license_scan(docs.withColumn("labels", F.lit(1))).collect()
    assert ordered(got) == ordered([(i, *plain_scan(t, None)) for i, t in pairs(docs)])


#: What people write, with the labels that the method adds to the base ones.
LICENSE_TEXTS = {
    "Released under the MIT License.": "mit",
    "Released under the BSD License": "bsd",
    "Released under the Apache License": "apache",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 2.0": "gpl-2.0",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3.0",
    "This work is licensed under the GNU Lesser General Public License, version 3": "lgpl-3.0",
    license_scan.GPL.format("GNU General Public License", "2"): "gpl-2.0",
    license_scan.GPL.format("GNU Affero General Public License", "3"): "agpl-3.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc-4.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "Released under the terms of a treaty": "",
    "The license of this work is of the public, 3 of 4": "",
}


def added(text):
    order = {w: i for i, w in enumerate(sorted({w for n in license_scan.NOTICES for w in license_scan.words(n.text.encode())}))}
    tokens = license_scan.words(text.encode())
    return license_scan.Scanner(license_scan.NOTICES, order, license_scan.THRESHOLD).scan(tokens)[2]


@pytest.mark.parametrize("text", LICENSE_TEXTS)
def test_license_labels(text):
    want = {LICENSE_TEXTS[text]} - {""}
    assert added(text) == want
    assert added("word " * 41 + text + " word" * 7) == want


def test_each_notice_is_told_from_every_other():
    for notice in license_scan.NOTICES:
        assert added(notice.text) == {notice.label}, notice
    for one in license_scan.NOTICES:
        for other in license_scan.NOTICES:
            assert added(one.text + " word" * 200 + " " + other.text) == {one.label, other.label}
    assert added("Released under the MIT License. Licensed under the Apache License, Version 2.0.") == {"mit", "apache-2.0"}


@pytest.mark.parametrize("table", ["awkward", "documents", "empty"])
def test_packing(request, table):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(table)
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = []
    for i, text in pairs(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.asarray(ids[k : k + 2048], "<u4")
            want.append((i, k // 2048, k, len(part), zlib.crc32(part.tobytes())))
    got = packing.packed(docs, default_tokenizer(), packer_pieces=100)
    rows = got.collect()
    assert ordered(r[:5] for r in rows) == ordered(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    if rows:
        assert len(bins) <= -(-total // 2048) * 1.03 + 1 + -(-len(rows) // 100)


def test_packer_chooses_least_squares():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 300)
    bins, offsets = packing.sum_of_squares(lengths, 64)
    gaps: dict[int, int] = {}
    for size, place, offset in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        counts = Counter(g for g in gaps.values() if g)

        def total(old, new, counts=counts):
            after = counts.copy()
            if old is not None:
                after[old] -= 1
            if new:
                after[new] += 1
            return sum(v * v for v in after.values())

        options = [total(g, g - size) for g in set(gaps.values()) if g >= size and g] + [total(None, 64 - size)]
        old = gaps.get(place)
        assert total(old, (64 if old is None else old) - size) == min(options)
        assert offset == 64 - (64 if old is None else old)
        gaps[place] = (64 if old is None else old) - size
