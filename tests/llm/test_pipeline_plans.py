"""Stages of the pipeline: what their plans no longer do twice, with the same results."""

from conftest import COLUMNS

from terrakit.llm import line_dedup, ngram_join, packing, quality_rules
from terrakit.llm.queries import default_tokenizer


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_carried_through_generators(awkward):
    plan = plan_of(quality_rules.document_stats(awkward).select("doc_id", *quality_rules.STATS))
    made = [line for line in plan.splitlines() if "Generate explode" in line]
    # Only those that make lines and words of them.
    assert sum("text#" in line for line in made) == 2 and "translate(" not in plan


def test_lines_are_hashed_once(awkward):
    assert "posexplode" not in plan_of(line_dedup.drop_repeated_lines(awkward))


def test_texts_are_cut_into_shingles_once(awkward):
    kept = ngram_join.one_of_each(awkward, words=5, percent=80)
    assert "MapInArrow" not in plan_of(kept)


def test_one_row_of_an_id_with_the_same_text_stays(spark):
    rows = [(1, "one two three", "a"), (1, "one two three", "b"), (1, "One  two three", "c"), (1, "four five", "d"), (2, " \t", "e"),
            (2, " \t", "f"), (3, None, "g"), (None, "one two three", "h"), (None, "six", "i")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], COLUMNS)
    kept = ngram_join.one_of_each(docs, words=5, percent=80).collect()
    assert sorted((r["text"] or "").lower().split() for r in kept) == [[], [], [], ["four", "five"], ["one", "two", "three"], ["six"]]
    assert {r["source"] for r in kept if not (r["text"] or "").strip()} == {"e", "f", "g"}
    assert [r["doc_id"] for r in kept if "one" in (r["text"] or "").lower()] == [None]


def test_copies_in_a_row_are_encoded_once():
    class Counted(bytes):
        lowered = 0

        def lower(self):
            Counted.lowered += 1
            return super().lower()

    texts = [Counted(t) for t in (b"One two", b"One two", b"One two", b"three", b"One two", b"", b"")]
    encoder = packing.WordEncoder(default_tokenizer())
    found = list(encoder.encode(texts))
    assert Counted.lowered == 4
    assert found == [encoder.ids(t.decode().lower()).tobytes() for t in texts]


def test_shingles_do_not_cross_texts():
    texts = [b"a b c d e f", b"a b", b"", b"c d e f g h", b"x"]
    alone = [next(iter(ngram_join.shingle_sets([t], 5))).tolist() for t in texts]
    assert [s.tolist() for s in ngram_join.shingle_sets(texts, 5)] == alone
