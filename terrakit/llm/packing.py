"""Sum-of-squares packing of token pieces into sequences.

Documents are tokenised and cut into pieces of at most one sequence. Pieces are dealt out
round robin to packers of a bounded number of pieces each; a packer places every piece
where the squared counts of open bins per residual gap become smallest, longest first.
A packer leaves a handful of bins open, so its share of waste falls with its size.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from terrakit.llm.common import raw_texts, worker_store
from terrakit.session import written

CAPACITY = 2048
PACKER_PIECES = 100_000

#: Bytes of words and ids that a worker keeps, with 130 for each entry's own cost (290,000
#: words of 5 to 13 letters took 141 bytes each in all). Speed only.
MEMO_BYTES = 64 << 20
ENTRY_BYTES = 130

#: Bytes of text whose new words are learned together.
GROUP_BYTES = 256 << 10

#: Words of one call of the tokenizer.
CALL_WORDS = 100

ENDING = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Ids of a text as the bytes of little-endian unsigned 32-bit numbers.

    The tokenizer lower-cases, normalises and splits at white space before it looks at
    words, and none of its rules looks across ASCII white space; so a text's ids are its
    words' ids in order, and words seen before need no second look. A-Z may be lower-cased
    ahead of the tokenizer unless a combining mark or a special token stands in the text.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The newer half of the table, and the older one, which goes when the newer is full.
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = marks[-1]
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        vocabulary = self.tokenizer.get_vocab()
        self.lasts = np.zeros(1 + max(vocabulary.values()), bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.lasts[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def keep(self, words: list[bytes], ids: np.ndarray, starts: list[int], stops: list[int]) -> None:
        coded = ids.tobytes()
        self.memo.update(zip(words, [coded[4 * a : 4 * b] for a, b in zip(starts, stops)], strict=True))
        self.held += sum(map(len, words)) + len(coded) + ENTRY_BYTES * len(words)

    def learn(self, words: list[bytes]) -> None:
        """Encode new words, many in one text. Letters, and ASCII punctuation behind them,
        are one part each, and a part's last id, and no other, ends a word. No such word has
        fewer parts than counted here, so where there are as many ends as parts, they tell
        the words apart. Others have a special token between them, and a word that may
        hold one itself is encoded alone."""
        plain, parts, others = [], [], []
        for word, text in zip(words, b" ".join(words).decode("utf-8", "replace").split(" "), strict=True):
            stem = text.rstrip(ENDING)
            if stem.isalpha() and (stem is text or len(stem) == len(text) or stem[-1] < "\u0250"):
                plain.append((word, text))
                parts.append(1 + (len(stem) < len(text)))
            else:
                others.append((word, text))
        for at in range(0, len(plain), CALL_WORDS):
            own, texts = zip(*plain[at : at + CALL_WORDS])
            ids = self.ids(" ".join(texts))
            ends = np.flatnonzero(self.lasts[ids]) + 1
            last = np.cumsum(parts[at : at + CALL_WORDS])
            if len(ends) == last[-1] and ends[-1] == len(ids):
                stops = ends[last - 1].tolist()
                self.keep(own, ids, [0, *stops[:-1]], stops)
            else:
                others.extend(plain[at : at + CALL_WORDS])
        for word, text in others:
            if "<|" in text:
                ids = self.ids(text)
                self.keep([word], ids, [0], [len(ids)])
        others = [pair for pair in others if "<|" not in pair[1]]
        for at in range(0, len(others), CALL_WORDS):
            own, texts = zip(*others[at : at + CALL_WORDS])
            ids = self.ids(f" {self.mark} ".join(texts))
            between = np.flatnonzero(ids == self.mark_id).tolist()
            self.keep(own, ids, [0, *(i + 1 for i in between)], [*between, len(ids)])

    def encode(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP_BYTES:
                yield from self.encode_group(group)
                group, size = [], 0
        yield from self.encode_group(group)

    def encode_group(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text. Copies that follow one another, as a mix makes them, are encoded once."""
        if self.held > MEMO_BYTES // 2:
            self.older, self.memo, self.held = self.memo, {}, 0
        new: set[bytes] = set()
        rows = []
        last = None
        for text in texts:
            if text == last:
                rows.append(rows[-1])
                continue
            last = text
            if not (b"\xcc" in text or b"\xcd" in text or b"<|" in text):
                text = text.lower()
            words = text.split()
            coded = list(map(self.memo.get, words))
            gaps = [i for i, ids in enumerate(coded) if ids is None] if None in coded else []
            unknown = [words[i] for i in gaps]
            new.update(unknown)
            rows.append((coded, gaps, unknown))
        again = {word: self.older[word] for word in new if word in self.older}
        self.memo.update(again)
        self.held += sum(len(word) + len(ids) + ENTRY_BYTES for word, ids in again.items())
        unseen = [word for word in new if word not in again]
        if unseen:
            self.learn(unseen)
        done, ids = None, b""
        for row in rows:
            if row is not done:
                coded, gaps, unknown = done = row
                for i, word in zip(gaps, unknown):
                    coded[i] = self.memo[word]
                ids = b"".join(coded)
            yield ids


def _pieces_of(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_store(f"encoder {path}", lambda: WordEncoder(path))
        end = np.asarray([end_id], "<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            ids = batch.column(0).to_pylist()
            for doc_id, coded in zip(ids, encoder.encode(raw_texts(batch.column(1)))):
                coded += end
                for piece, at in enumerate(range(0, len(coded), width)):
                    part = coded[at : at + width]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document.

    A document's ids end with ``end_id``; a null or empty text has that id alone. Only a
    document of more than ``capacity`` ids is cut. Repeated rows give their pieces again.
    """
    return docs.select("doc_id", "text").mapInArrow(_pieces_of(tokenizer, capacity, end_id), PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order.

    ``open[g]`` counts bins with gap ``g``. Moving a bin from gap g to g - s changes the
    sum of squares by 2 (open[g - s] - open[g]) + 2, where gap 0 does not count; a new
    bin adds 2 open[capacity - s] + 1. Ties go to the smallest gap, a new bin last.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_bins = np.zeros(capacity + 1, np.int64)
    at_gap: dict[int, list[int]] = defaultdict(list)
    made = 0
    for i, size in enumerate(lengths.tolist()):
        gap = -1
        if size < capacity:
            here = open_bins[size:capacity]
            after = open_bins[: capacity - size]
            change = 2 * (after - here) + 2
            if size:
                change[0] = 1 - 2 * here[0]
            change[here == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if change[best] <= 2 * open_bins[capacity - size] + 1:
                gap = size + best
        if gap < 0:
            gap, place = capacity, made
            made += 1
        else:
            place = at_gap[gap].pop()
            open_bins[gap] -= 1
        bins[i], offsets[i] = place, capacity - gap
        left = gap - size
        if left:
            at_gap[left].append(place)
            open_bins[left] += 1
    return bins, offsets


def _packer(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        yield rows.assign(sequence_id=bins + (TaskContext.get().partitionId() << 32), offset=offsets)

    return run


def packed(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, packer_pieces: int = PACKER_PIECES
) -> DataFrame:
    """Every piece with its ``sequence_id`` and its ``offset`` in that sequence.

    The pieces are written before they are dealt out, so a packer that is run again after
    a loss gets the same rows. Empty table: empty result.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    packers = max(1, math.ceil(pieces.count() / packer_pieces))
    return pieces.repartition(packers).mapInPandas(
        _packer(capacity), PIECES + ", sequence_id long, offset long"
    )
