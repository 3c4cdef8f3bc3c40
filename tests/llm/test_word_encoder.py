"""Ids of words learned in groups against the tokenizer itself, and what learning costs."""

import random

import numpy as np

from terrakit.llm import packing
from terrakit.llm.queries import default_tokenizer

BITS = [
    "a", "B", "the", "é", "É", "İ", "ß", "ᾳ", "中", "क़", "한", "ᄒ", "²", "½", "9", "Ⅷ", "'s", "'LL", "'", ".",
    ",", "!?", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x85", "\xa0", "​", "😀", "K", "ͅ", "<", "̸", "ﬁ",
    "\U0001e900", "Σ", "ʰ", "_", "\x00", " ", " ", " ", "\n",
]


def test_ids_are_the_tokenizers(monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 2_000, raising=False)
    monkeypatch.setattr(packing, "MEMO_BYTES", 50_000)
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(60))).encode() for _ in range(3000)]
    encoder = packing.WordEncoder(default_tokenizer())
    for text, ids in zip(texts, encoder.encode(iter(texts)), strict=True):
        want = encoder.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        assert ids == np.asarray(want, "<u4").tobytes()
    assert list(encoder.encode(iter([]))) == [] and list(encoder.encode(iter([b"", b" "]))) == [b"", b""]


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_of_letters_need_no_token_between_them_and_frequent_ones_stay_known(monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 2_000, raising=False)
    monkeypatch.setattr(packing, "MEMO_BYTES", 200_000)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(9))
    often = [word() for _ in range(100)]
    texts = [" ".join([*often, *(word() + rng.choice(["", ".", "###"]) for _ in range(100))]).encode() for _ in range(200)]
    encoder = packing.WordEncoder(default_tokenizer())
    encoder.tokenizer = Counted(encoder.tokenizer)
    seen = sum(len(ids) for ids in encoder.encode(texts))
    assert seen and not any("<|" in text for text in encoder.tokenizer.texts)
    learned = [w for text in encoder.tokenizer.texts for w in text.split()]
    assert len(learned) <= 200 * 100 + 2 * len(often)
    assert len(encoder.memo) + len(encoder.older) < 200_000 // 100
