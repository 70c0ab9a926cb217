"""Packing encodes the words of many texts together."""

import os
import random
import sys

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

import numpy as np
import pytest
from tokenizers import Tokenizer

from cytoloom.llm import bpe
from cytoloom.llm.queries import vocabulary

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", " ", "\n", "a", "'s", "it's", "x'", "don't.", "été,", "1,234.5", "a  b", "a\x1cb", "Σας", "A<|endoftext|>b", "é", "ab" * 300, "a." * 200, "ñ" * 17, "𝔘𝔫!", "中文。", "ªº", "x y"]


def texts(n):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeinorst'.,1éßя字") for _ in range(rng.randrange(1, 40)))
    return ODD + [" ".join(rng.choice([word(), rng.choice(ODD)]) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("few, together, kept", [(0, 1 << 20, 48 << 20), (0, 500, 40 * bpe.ENTRY), (0, 1, 0), (1_000, 1 << 20, 48 << 20)])
def test_texts_together_equal_the_library(monkeypatch, name, few, together, kept):
    monkeypatch.setattr(bpe, "FEW", few)
    monkeypatch.setattr(bpe, "TOGETHER", together)
    monkeypatch.setattr(bpe, "KEPT", kept)
    theirs, found = Tokenizer.from_file(vocabulary(name)), texts(300)
    packed = list(bpe.load(vocabulary(name)).packed_all(found))
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [e.ids for e in theirs.encode_batch(found, add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
def test_new_words_are_not_scanned_one_by_one(monkeypatch, name):
    scanned, encoder = [], bpe.load(vocabulary(name))
    scan = encoder.scan
    monkeypatch.setattr(encoder, "scan", lambda parts: scanned.append(1) or scan(parts))
    rng = random.Random(3)
    found = [" ".join("".join(rng.choice("aeinorst") for _ in range(9)) for _ in range(100)) for _ in range(100)]
    list(encoder.packed_all(found))
    assert len(scanned) <= len(found)  # at most the word that a text starts with


@pytest.mark.parametrize("name", NAMES)
def test_letters_are_those_of_the_pattern(name):
    split = bpe.read(vocabulary(name)).split
    letters = "".join(c for c in map(chr, range(0x110000)) if c.isalpha())
    assert split(letters) == [letters]
