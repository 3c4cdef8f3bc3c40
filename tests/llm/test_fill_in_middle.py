"""Fill-in-middle against a plain version over code points."""

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import COLUMNS, rows_of
from pyspark.sql import functions as F

from terrakit.llm.fill_in_middle import ExceptionIndex, fill_in_middle, restored, token_ends

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    tokens = TOKENS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_rows():
    rng = random.Random(3)
    some = ["a", "é", "ñandú", "漢字", "😀", "<", "P>", "<P", "x<M>y", " ", "\t\n", "\x0b", "\x85", " ", "\x00", "word"]
    rows = [(1000 + i, "".join(rng.choice(some) + rng.choice(["", " "]) for _ in range(rng.randrange(40)))) for i in range(400)]
    rows += [(2000 + i, "<P> in the text") for i in range(8)] + [(3000 + i, "ends in blanks  \n") for i in range(8)]
    rows += [(4000 + i, " \n ") for i in range(8)] + [(5000 + i, "é😀 " * 40_000) for i in range(4)] + [(5001, "again")] * 2
    return [(i, t, "en", "s", 1) for i, t in rows]


def test_against_plain_version(spark, awkward):
    docs = awkward.unionByName(spark.createDataFrame(odd_rows(), COLUMNS)).withColumns(
        {"n": F.lit("clash"), "output": F.lit(1), "form": F.lit(2), "__text": F.lit(3)}
    )
    got = fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    asked = docs.select("doc_id", "text").collect()
    assert rows_of(got) == sorted((plain_version(*r) for r in asked), key=repr)
    forms = {r.form for r in got.select("form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}


def test_restored(spark):
    docs = spark.createDataFrame(odd_rows(), COLUMNS).repartition(5)
    back = fill_in_middle(docs, fim_percent=100).select("doc_id", restored(F.col("output"), F.col("form")))
    assert rows_of(back) == sorted(((r[0], r[1]) for r in odd_rows()), key=repr)


def test_other_ids_marks_and_empty(spark, empty):
    assert fill_in_middle(empty).collect() == []
    docs = spark.createDataFrame([("k1", "one two three"), (None, "x y")], "doc_id string, text string")
    rows = fill_in_middle(docs, fim_percent=100, marks=("[a", "{b", "(c")).collect()
    assert {r.doc_id for r in rows} == {"k1", None} and all("(c" in r.output for r in rows)
    with pytest.raises(ValueError):
        fill_in_middle(docs, marks=("<a<", "{b", "(c"))


def test_index_there_and_back():
    rng = random.Random(8)
    for _ in range(50):
        text = "".join(rng.choice(["a", " ", "é", "漢", "😀"]) for _ in range(rng.randrange(60)))
        data = np.frombuffer(text.encode(), np.uint8)
        index = ExceptionIndex(data)
        for chars in range(len(text) + 1):
            cut = len(text[:chars].encode())
            assert index.chars(cut) == chars and index.bytes(chars) == cut
        assert len(token_ends(data)) == len(TOKENS.findall(text))
    assert len(ExceptionIndex(np.frombuffer(b"ascii only", np.uint8)).at) == 0
