"""A small table of awkward documents, and the driver's smallest tables."""

import random

import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows():
    rng = random.Random(5)
    names = [f"w{i}" for i in range(400)]
    base = [rng.choice(names) for _ in range(120)]
    rows = []
    for k in range(60):  # near copies of one text, some too far from it
        words = list(base)
        for _ in range(k % 7):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, rows[0][1]) for k in range(5)]  # exact copies
    passage = " ".join(f"p{i}" for i in range(40))
    for k in range(30):
        rows.append((300 + k, passage + "\n" + " ".join(rng.choice(names) for _ in range(20 + k))))
    long_text = " ".join(rng.choice(names) for _ in range(30_000))
    line = "This line of text is found in Many documents\n"
    rows += [
        (0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "Été ÉTÉ é"),
        (7, long_text), (8, long_text + " tail"), (9, line * 50), (10, line + "own words here"),
        (11, "  " + line.upper() + "\n\n"), (12, "short\nshort\nshort"), (13, "a" * 100_000),
        (14, "\n".join(f"Line number {i} of this long text" for i in range(3000))),
        (15, "\n".join(f"Line number {i} of this long text" for i in range(0, 3000, 2))),
        (16, "\n".join(f"  line NUMBER {i} of this long text " for i in range(0, 3000, 3))),
        (None, "a text without an id\n" + line), (None, None), (17, "repeat repeat " * 30), (17, "repeat repeat " * 30),
        (17, "another text of a repeated id, with more than a few words in it"),
        (18, "CC BY\tcc-by general public license. All Rights reserved"), (19, "Released under the MIT License."),
        (20, "Permission is hereby granted free of charge to any person obtaining a copy of this software"),
        (21, "### *** $$$ %%% &&& ||| <<< >>> " * 8), (22, "x \x1cy z w \x85 q"), (23, "tie tie"), (24, "tie tie"),
    ]
    sources = ["b", None, "a", "Z", "é", "b", "b"]
    return [(i, t, "en", sources[n % 7], 7) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
