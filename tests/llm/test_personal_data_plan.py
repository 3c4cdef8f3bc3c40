"""Personal data: rare signs are looked for first, texts come back only where they are asked for."""

import re

import pytest
from test_personal_data import MODEL, odd_texts

from terrakit.llm import personal_data as pd_
from terrakit.llm import queries

WHOLE_RUNS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")


class Counting:
    """A pattern that counts how often it is asked."""

    def __init__(self, pattern):
        self.pattern, self.calls = pattern, 0

    def finditer(self, text):
        self.calls += 1
        return self.pattern.finditer(text)


def test_addresses_are_the_same_whole_digit_runs():
    for text in [*odd_texts(), "1.2.3.4.5.6.7.8", "1.22.333.4444", "é1.2.3.4", "12.1.2.3.4", "1" * 50 + ".1.1.1"]:
        assert [m.span() for m in pd_._IP.finditer(text)] == [m.span() for m in WHOLE_RUNS.finditer(text)], text


def test_spoken_signs_are_looked_for_where_they_can_be(monkeypatch):
    pattern = Counting(pd_._SPOKEN_AT)
    monkeypatch.setattr(pd_, "_SPOKEN_AT", pattern)
    assert list(pd_.spoken_segments("look at that house " * 50)) == [] and pattern.calls == 0
    for text in ("joe at home dot com", "JOE AT HOME DOT COM", "joe [at] home.com", "joe{ At }home.com"):
        assert list(pd_.spoken_segments(text)), text
    assert pattern.calls == 4


def test_texts_that_may_hold_a_sign_are_all_looked_at():
    for text in odd_texts():
        if pd_._SPOKEN_AT.search(text):
            assert " dot " in text.lower() or pd_._IN_BRACKETS.search(text), text


def test_rules_run_where_there_is_a_stretch(monkeypatch):
    texts = odd_texts()
    before = [list(pd_.sure_forms(t)) for t in texts]
    asked = []
    rules = pd_.base_spans
    monkeypatch.setattr(pd_, "base_spans", lambda text: asked.append(text) or rules(text))
    assert [list(pd_.sure_forms(t)) for t in texts] == before and any(before)
    assert asked == [t for t in texts if any(len(s.groups) <= pd_.MOST_GROUPS for s in pd_.stretches(t))] and len(asked) < len(texts)


@pytest.mark.parametrize("masked", [True, False])
def test_masked_texts_are_made_where_they_are_asked_for(awkward, masked):
    rows = pd_.find_personal_data(awkward, MODEL, masked=masked)
    assert ("masked" in rows.columns) == masked
    spans = rows.select("doc_id", "base", "spans")
    assert sorted(map(str, spans.collect())) == sorted(map(str, pd_.find_personal_data(awkward, MODEL).drop("masked").collect()))


def test_query_brings_no_text_back(spark):
    rows = queries.op12_personal_data(spark, "/root/testdata/sf0.001")
    assert "masked" not in rows._jdf.queryExecution().analyzed().toString()
