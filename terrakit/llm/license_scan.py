"""License scans: an exact containment join of text blocks with license notices.

A template is the set of words of a notice; a block is a window of twice the notice's
length that moves by its length, so any passage of that length lies inside one. A block
matches when it holds at least ``THRESHOLD`` of the template's words. Words are ordered
by the number of documents that hold them, counted over the whole corpus, rarest first:

- prefix: a matching block holds one of the first ``n - needed + 1`` words of the template;
- length: it has at least ``needed`` words;
- position: with ``r`` words of the template ahead of the first that it holds, at most
  ``n - r`` can match.

Notices of related licenses share most of their words, so a block that holds enough of
them must also show the notice's marks, name and version, word for word. Where several
notices match around one name, the one with most words wins; equals all stay.

The templates are a fixed short list, so the join runs where the documents are read and
no text is shuffled. Only the counts of template words travel.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakit.llm.common import UPPER, raw_texts

THRESHOLD = 0.8

# Phrases with the label that every place of them gives.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}


class Notice(NamedTuple):
    """A license notice: its words are matched as a set, its marks word for word.

    Of every group of marks one must stand in the block, as consecutive words: the name
    of the license first, then what tells it from its relatives.
    """

    label: str
    text: str
    marks: tuple[tuple[str, ...], ...]


# Usual license notices with the name and version words that each must show.
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published "
    "by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
)
NOTICES = (
    Notice("apache", "Licensed under the Apache License", (("apache license",),)),
    Notice("apache-2.0", "Licensed under the Apache License, Version 2.0", (("apache license",), ("version 2 0", "v2 0"))),
    Notice("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
           "compliance with the License. You may obtain a copy of the License at", (("apache license",), ("version 2 0",))),
    Notice("bsd", "Released under the BSD License", (("bsd license", "clause bsd"),)),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
           "provided that the following conditions are met", (("source and binary forms",),)),
    Notice("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
           "promote products derived from this software without specific prior written permission",
           (("endorse or promote products",),)),
    Notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
           (("with or without fee",),)),
    Notice("mit", "Released under the MIT License", (("mit license",),)),
    Notice("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files", (("free of charge to any person",),)),
    Notice("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
           (("mozilla public license",), ("v 2 0", "version 2 0", "v2 0"))),
    Notice("unlicense", "This is free and unencumbered software released into the public domain",
           (("free and unencumbered software",),)),
    *[
        Notice(f"{short}-{version}.0", text, ((name.lower(),), (f"version {version}", f"v{version}")))
        for short, name, versions in (
            ("gpl", "GNU General Public License", "23"),
            ("lgpl", "GNU Lesser General Public License", "3"),
            ("agpl", "GNU Affero General Public License", "3"),
        )
        for version in versions
        for text in (f"This work is licensed under the {name}, version {version}", GPL.format(name, version))
    ],
    *[
        notice
        for short, name in (
            ("by", "Attribution"), ("by-sa", "Attribution ShareAlike"), ("by-nc", "Attribution NonCommercial"),
            ("by-nd", "Attribution NoDerivatives"), ("by-nc-sa", "Attribution NonCommercial ShareAlike"),
            ("by-nc-nd", "Attribution NonCommercial NoDerivatives"),
        )
        for notice in (
            Notice(f"cc-{short}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License",
                   ((f"creative commons {name.lower()} 4 0",),)),
            Notice(f"cc-{short}-4.0", f"Licensed under CC {short} 4.0", (("cc " + short.replace("-", " ") + " 4 0",),)),
        )
    ],
)

KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
FOLD = bytes(
    ord(chr(b).lower()) if chr(b) in UPPER else b if b in KEPT else 0x20 for b in range(256)
)

RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double"
)


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, with A-Z lower-cased."""
    return text.translate(FOLD).split()


def _count_words(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in raw_texts(batch.column(0)):
                counts.update(vocabulary.intersection(words(text)))
            found = sorted(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in found], pa.string()), pa.array([counts[w] for w in found], pa.int64())],
                ["word", "n"],
            )

    return run


def word_order(docs: DataFrame, notices: tuple[Notice, ...]) -> dict[bytes, int]:
    """Rank of every template word, rarest first, by documents that hold it."""
    vocabulary = frozenset(w for t in notices for w in words(t.text.encode()))
    rows = docs.select("text").mapInArrow(_count_words(vocabulary), "word string, n long")
    counts = {r["word"].encode(): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


class Scanner:
    """Base phrases and template blocks of one document at a time."""

    def __init__(self, notices: tuple[Notice, ...], order: dict[bytes, int], threshold: float):
        self.phrases = [(words(p.encode()), label) for p, label in PHRASES.items()]
        self.templates = []
        for label, text, marks in notices:
            spoken = words(text.encode())
            groups = [[words(m.encode()) for m in group] for group in marks]
            ranked = sorted(set(spoken), key=order.__getitem__)
            needed = next(k for k in range(len(ranked) + 1) if k >= threshold * len(ranked) - 1e-9)
            rank = {w: r for r, w in enumerate(ranked)}
            prefix = frozenset(ranked[: len(ranked) - needed + 1])
            self.templates.append((label, len(spoken), rank, needed, prefix, groups))
        self.anchors = frozenset(p[-1] for p, _ in self.phrases).union(*[t[4] for t in self.templates])

    def scan(self, tokens: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, their labels, the templates' labels, the best containment."""
        starts: list[int] = []
        base: set[str] = set()
        if self.anchors.isdisjoint(tokens):
            return starts, base, set(), 0.0
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(tokens):
            if w in self.anchors:
                places.setdefault(w, []).append(i)
        for phrase, label in self.phrases:
            n = len(phrase)
            found = [i - n + 1 for i in places.get(phrase[-1], []) if i >= n - 1 and tokens[i - n + 1 : i + 1] == phrase]
            starts += found
            if found:
                base.add(label)
        score = 1.0 if starts else 0.0
        best: dict[int, tuple[int, set[str]]] = {}
        for label, size, rank, needed, prefix, groups in self.templates:
            hits = sorted(i for w in prefix for i in places.get(w, []))
            for block in sorted({b for i in hits for b in (i // size - 1, i // size) if b >= 0}):
                inside = tokens[block * size : (block + 2) * size]
                if len(inside) < needed:
                    continue
                at = bisect_left(hits, block * size)
                first = min(rank[tokens[i]] for i in hits[at : bisect_left(hits, (block + 2) * size)])
                if len(rank) - first < needed:
                    continue
                shared = len(rank.keys() & set(inside))
                shown = [_standing(inside, group) for group in groups] if shared >= needed else [[]]
                if not all(shown):
                    continue
                score = max(score, shared / len(rank))
                for name in shown[0]:
                    most, winners = best.get(block * size + name, (0, set()))
                    if shared > most:
                        best[block * size + name] = (shared, {label})
                    elif shared == most:
                        winners.add(label)
        labels = set().union(*[winners for _, winners in best.values()])
        return sorted(starts), base, labels, score


def _standing(tokens: list[bytes], phrases: list[list[bytes]]) -> list[int]:
    """Starts of all places where one of the phrases stands."""
    return [
        i for phrase in phrases for i, w in enumerate(tokens)
        if w == phrase[0] and tokens[i : i + len(phrase)] == phrase
    ]


def _scan(notices: tuple[Notice, ...], order: dict[bytes, int], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, order, threshold)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        names = [part.split()[0] for part in RESULT.split(", ")]
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in names)
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                tokens = words(text)
                starts, base, labels, score = scanner.scan(tokens)
                row = (
                    doc_id, len(tokens), len(starts), starts[0] if starts else None, starts[-1] if starts else None,
                    ",".join(sorted(base)), ",".join(sorted(base | labels)), score,
                )
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return run


def license_scan(
    docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs`` with the columns of RESULT.

    ``n_base`` counts all places where a base phrase's words stand consecutively, with
    their smallest and largest first word (from 0). ``labels`` adds the notices that a block
    contains to ``threshold``, with their marks, and that no fuller notice around the same
    name beats; ``score`` is 1 where a base phrase stands, else the largest containment of
    a notice whose marks stand, else 0.

    - Null or empty text: no words, no labels (empty strings), score 0.
    - A text that is shorter than a block is one block.
    - Repeated rows are scanned alike; a null ``doc_id`` stays null.
    - Other columns do not take part. Empty table: empty result.
    """
    order = word_order(docs, notices)
    return docs.select("doc_id", "text").mapInArrow(_scan(notices, order, threshold), RESULT)
