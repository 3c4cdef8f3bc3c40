"""Fill-in-middle form of documents, cut at token ends.

A text's tokens are its words with the white space before them, and white space at the
end. Cuts are found in bytes and given in code points. Between the two stands a sparse
exception index: positions and excess bytes of the characters of several bytes only, so a
cut is its own place plus the excess that a binary search finds before it; where a text is
ASCII the index is empty and the two are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakit.llm.common import raw_texts

SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes of output after which a task hands on what it has.
BATCH_BYTES = 8 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

ADDED = (
    "n long, form string, prefix_bytes long, middle_bytes long, prefix_chars long, middle_chars long, output string"
)


class ExceptionIndex:
    """Where a UTF-8 text holds characters of more than one byte.

    ``at`` has the byte and ``char`` the code point position of each, ascending; ``excess``
    the bytes beyond one a character that all before it take, with the total at its end.
    Size and time follow the exceptions, not the text.
    """

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        own = 1 + (lead >= 0xE0) + (lead >= 0xF0)
        self.excess = np.concatenate(([0], np.cumsum(own)))
        self.char = self.at - self.excess[:-1]

    def chars(self, cut: int) -> int:
        """Code points before the byte ``cut``, which starts a character."""
        return int(cut - self.excess[np.searchsorted(self.at, cut)])

    def bytes(self, cut: int) -> int:
        """Bytes before the code point ``cut``."""
        return int(cut + self.excess[np.searchsorted(self.char, cut)])


def token_ends(data: np.ndarray) -> np.ndarray:
    """The byte after each token, ascending. White space is ASCII, so bytes are enough."""
    if not len(data):
        return np.zeros(0, np.int64)
    blank = _BLANK[data]
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(data))


#: Arrow kinds of the added columns, in the order of ``ADDED``.
KINDS = [
    (name, pa.string() if kind == "string" else pa.int64())
    for name, kind in (column.split() for column in ADDED.split(", "))
]


def _rows(marks: tuple[bytes, bytes, bytes], fim_percent: int, spm_percent: int):
    first, second, third = marks

    def changed(text: bytes, h: list[int]) -> tuple:
        data = np.frombuffer(text, np.uint8)
        ends = token_ends(data)
        n = len(ends)
        if not n or h[2] % 100 >= fim_percent or any(m in text for m in marks):
            return n, "plain", None, None, None, None, text
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
        index = ExceptionIndex(data)
        head, body, tail = text[:a], text[a:b], text[b:]
        if h[3] % 100 < spm_percent:
            form, output = "spm", second + tail + first + head + third + body
        else:
            form, output = "psm", first + head + second + tail + third + body
        return n, form, a, b - a, index.chars(a), index.chars(b) - index.chars(a), output

    def batch_of(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        columns = [ids] + [pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), KINDS)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *(name for name, _ in KINDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            draws = np.array(batch.column("__h").flatten(), np.int64).reshape(-1, 4).tolist()
            rows, start, held = [], 0, 0
            for i, text in enumerate(raw_texts(batch.column("__text"))):
                rows.append(changed(text, draws[i]))
                held += len(text)
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield batch_of(ids.slice(start, len(rows)), rows)
                    start, rows, held = i + 1, [], 0

    return run


def fill_in_middle(
    docs: DataFrame,
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """``doc_id`` with ``n, form, prefix_bytes, middle_bytes, prefix_chars, middle_chars, output``.

    Four draws come from the hash of ``seed:doc_id``, so a rerun, or another partitioning,
    gives the same rows. A null text counts as empty and an empty one stays plain, as does
    one that holds a mark. A null id counts as the empty string in the hash. Repeated rows
    give equal rows; rows of one id and unlike texts are cut each by its own tokens. Other
    columns, whatever their names, do not matter. Empty table: empty result. A row is
    worked on alone: no shuffle, and a task hands on output every few megabytes.
    """
    if len({*marks}) != 3 or any(m[0] in other[1:] for m in marks for other in marks):
        raise ValueError("marks must be three strings whose first characters stand nowhere else in them")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"), draws.alias("__h"))
    run = _rows(tuple(m.encode() for m in marks), fim_percent, spm_percent)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {ADDED}")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The exact text again. No text of a changed form holds a mark, so the marks found
    first are the ones put there."""
    first, second, third = marks
    body = F.substring_index(output, third, -1)
    rest = F.substring_index(output, third, 1)
    psm_head = F.substring_index(F.substring_index(rest, second, 1), first, -1)
    psm_tail = F.substring_index(rest, second, -1)
    spm_head = F.substring_index(rest, first, -1)
    spm_tail = F.substring_index(F.substring_index(rest, first, 1), second, -1)
    return (
        F.when(form == "psm", F.concat(psm_head, body, psm_tail))
        .when(form == "spm", F.concat(spm_head, body, spm_tail))
        .otherwise(output)
    )
