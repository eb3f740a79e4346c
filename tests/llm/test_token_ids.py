"""Ids by pieces against the tokenizers library."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from draftlake.llm import token_planes
from draftlake.llm.registry import vocabulary

ALPHABETS = (
    "abc xyz ABC 019 .,;:!?-()[]{}<>|&%$#@*_~`^+=/\\\" \n\t\r\x0b\x0c",
    "aéßöÿ÷×µªºÅ'KÅİ \n<|endoftext|>",
    "á   中文Σσ Z9'sn't\n\n\x00\x1c",
)


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_ids_like_the_library(alphabet):
    rng, words, whole = random.Random(len(alphabet)), token_planes.WordIds(vocabulary()), Tokenizer.from_file(vocabulary())
    assert words.short
    for _ in range(1_500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        if rng.random() < 0.2:
            text += rng.choice(["<|endoftext|>", "<|im_start|>", "it's", "We'LL", "\nplain words, 2 of them.\n"])
        got = np.frombuffer(words.text(text.encode()), "<u4").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids, text


def other_vocabularies():
    import pathlib

    return sorted(str(p) for p in pathlib.Path(vocabulary()).parent.glob("*.json") if str(p) != vocabulary())


@pytest.mark.parametrize("path", other_vocabularies() or [None])
def test_another_vocabulary_takes_the_full_tokenizer(path):
    if path is None:
        pytest.skip("one vocabulary only")
    try:
        whole = Tokenizer.from_file(path)
    except Exception:
        pytest.skip("not a tokenizer of this library")
    words = token_planes.WordIds(path)
    for text in ("", "Plain words, 12 of them.", "Straße\n\nÉté á 中文"):
        assert np.frombuffer(words.text(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_null_is_empty():
    assert token_planes.WordIds(vocabulary()).text(None) == b""


def test_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(token_planes, "CACHE", 3)
    words, whole = token_planes.WordIds(vocabulary()), Tokenizer.from_file(vocabulary())
    for text in ("one two three four", "five one two six", "one seven four, four"):
        assert np.frombuffer(words.text(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(words.pieces) <= 3


