"""Personal data: the rules against plain patterns, the field against held-out examples."""

import itertools
import random
import re
import time

import numpy as np
from conftest import COLUMNS, rows_of
from pyspark.sql import functions as F

from terrakit.llm import personal_data as pd_

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def checks(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and checks(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, m.end()))
    return sorted(out)


MODEL = pd_.fit([])


def odd_texts():
    rng = random.Random(11)
    some = ["1", "23", "255", "256", "4111111111111111", "+", "1.2.3.4", ".", " ", "-", "(", ")", "a", "b@c", "@", "d.e", "é", "😀",
            "+1 (555) 555-0100", "x.y%z@q-r.com", "00", "\n", " at ", " dot ", "[at]", "card"]
    return ["".join(rng.choice(some) for _ in range(rng.randrange(25))) for _ in range(4000)]


def test_rules_against_plain_patterns():
    for text in odd_texts() + [pd_.example(random.Random(i))[0] for i in range(500)]:
        assert pd_.base_spans(text) == plain_base(text), text


def test_added_spans_overlap_nothing():
    for text in odd_texts():
        base, spans = MODEL.spans(text)
        assert set(base) <= set(spans) and spans == sorted(spans)
        added = sorted(set(spans) - set(base))
        for a in added:
            assert not any(a != b and a[0] < b[2] and b[0] < a[2] for b in spans), text


def test_choice_against_all_ways():
    """The dynamic programme finds the best of all sets of candidates."""
    rng = random.Random(5)
    for _ in range(200):
        text = " ".join(pd_.example(rng)[0] for _ in range(2))[:70]
        base, spans = MODEL.spans(text)
        free = lambda a, b: not any(a < s[2] and s[0] < b for s in base)
        some = list(MODEL.scored(text, free))
        if len(some) > 12:
            continue
        best = 0.0
        for n in range(len(some) + 1):
            for chosen in itertools.combinations(some, n):
                chosen = sorted(chosen)
                if all(x[1] <= y[0] for x, y in zip(chosen, chosen[1:])):
                    best = max(best, sum(c[3] for c in chosen))
        score = {(a, k, b): s for a, b, k, s in some}
        assert abs(sum(score[s] for s in set(spans) - set(base)) - best) < 1e-9


def test_marginals_against_all_ways():
    some = [[0, 2, 0], [1, 3, 1], [2, 3, 2], [0, 1, 0], [1, 2, 3]]
    scores = [0.5, -0.3, 1.2, 0.1, -2.0]
    ends = [[k for k, s in enumerate(some) if s[1] == e] for e in range(4)]
    starts = [[k for k, s in enumerate(some) if s[0] == e] for e in range(4)]
    weight, by_segment = 0.0, np.zeros(len(some))
    for n in range(len(some) + 1):
        for chosen in itertools.combinations(range(len(some)), n):
            spans = sorted(some[k][:2] for k in chosen)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):
                w = np.exp(sum(scores[k] for k in chosen))
                weight += w
                by_segment[list(chosen)] += w
    assert np.allclose(pd_._marginals(some, scores, ends, starts), by_segment / weight)


def test_held_out_examples():
    rng = random.Random(99)
    hit = more = missed = 0
    for _ in range(1500):
        text, gold = pd_.example(rng)
        base, spans = MODEL.spans(text)
        found, right = set(spans) - set(base), set(gold) - set(base)
        hit, more, missed = hit + len(found & right), more + len(found - right), missed + len(right - found)
    assert hit / (hit + missed) > 0.9 and hit / (hit + more) > 0.95


def test_what_rules_take_for_one():
    named = lambda t: [(pd_.KINDS[k], t[a:b]) for a, k, b in MODEL.spans(t)[1]]
    assert named("raie 7536784127813050 4845168114407329 cai") == [("card", "7536784127813050"), ("card", "4845168114407329")]
    assert named("x +1 (826) 555-4081 190.137.223.204 du") == [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")]
    assert named("tel: (743) 555-3824 ok") == [("phone", "(743) 555-3824")]
    assert named("12.05.1999 - 13.06.2001") == named("serial 9807915762804490") == named("ISBN 978-3-16-148410-0") == []


def test_linear_in_long_texts():
    for text in ("1" * 2_000_000, "a" * 2_000_000, "a@" * 200_000, "+" * 300_000, "1.2." * 30_000, " at a dot " * 20_000):
        start = time.time()
        MODEL.spans(text)
        assert time.time() - start < 20


def test_operator(spark, awkward, empty):
    docs = awkward.unionByName(
        spark.createDataFrame([(9000 + i, t, "en", "s", 1) for i, t in enumerate(odd_texts()[:300])], COLUMNS)
    ).withColumns({"base": F.lit("clash"), "masked": F.lit(1)})
    rows = pd_.find_personal_data(docs, MODEL).select(
        "doc_id", pd_.written_spans(F.col("base")), pd_.written_spans(F.col("spans")), "masked"
    )
    write = lambda spans: ",".join(f"{pd_.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    want = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        base, spans = MODEL.spans(text or "")
        assert base == plain_base(text or "")
        want.append((doc_id, write(base), write(spans), pd_._masked(text or "", spans)))
    assert rows_of(rows) == sorted(want, key=repr)
    assert pd_.find_personal_data(empty).collect() == []


def test_masked():
    text = "é +1 (826) 555-4081 190.137.223.204 du"
    assert pd_._masked(text, MODEL.spans(text)[1]) == "é <phone> <ip> du"


def test_fit_on_corpus(documents):
    forms = pd_.corpus_forms(documents, 50)
    assert forms == sorted(forms, key=lambda f: (-f[1], f[0])) and forms
    model = pd_.fit(forms)
    text = "raie 7536784127813050 4845168114407329 cai"
    assert len(model.spans(text)[1]) == 2
