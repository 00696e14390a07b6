import random

import numpy as np
import pyarrow as pa

from tests.llm.brute import shingle_set, words
from yardstats.llm import words as w


def _read(texts):
    found = list(w.WordReader().read(pa.array(texts, pa.string())))
    hashes = np.concatenate([h for _, h, _ in found]) if found else np.zeros(0)
    owner = np.concatenate([first + o for first, _, o in found]) if found else np.zeros(0)
    return hashes.tolist(), owner.tolist()


def test_same_words_same_hashes(monkeypatch):
    pick = random.Random(4)
    for block in (8, 16, 64, 1 << 18):
        monkeypatch.setattr(w, "BLOCK", block)
        for _ in range(60):
            texts = [
                None if pick.random() < 0.1 else "".join(pick.choice(" \n\tabABéz\x1c") for _ in range(pick.randint(0, 30)))
                for _ in range(pick.randint(0, 12))
            ]
            hashes, owner = _read(texts)
            expected = [(i, word) for i, text in enumerate(texts) for word in words(text)]
            assert owner == [i for i, _ in expected]
            by_word = {}
            assert all(by_word.setdefault(word, h) == h for h, (_, word) in zip(hashes, expected))
            assert len(set(by_word.values())) == len(by_word)


def test_words_longer_than_a_block():
    hashes, owner = _read(["a" * 700_000 + " b", "x " * 300_000, "", "y" * 300_000])
    assert owner == [0] * 2 + [1] * 300_000 + [3]
    assert len(set(hashes)) == 4


def test_set_sizes():
    texts = ["a b c d e f", "A B", "", None, "a a a a a a a a", "x"]
    sizes = [len(s) for s in w.shingle_sets(w.WordReader(), pa.array(texts))]
    assert sizes + [0] * (len(texts) - len(sizes)) == [len(shingle_set(t)) for t in texts]


def test_one_set_per_text_in_every_block(monkeypatch):
    pick = random.Random(7)
    for block in (4, 16, 1 << 18):
        monkeypatch.setattr(w, "BLOCK", block)
        for _ in range(60):
            texts = [
                pick.choice([None, "", " \n", "a", "a b c d e f g", "b c d e f g h i"]) for _ in range(pick.randint(0, 12))
            ]
            sizes = [len(s) for s in w.shingle_sets(w.WordReader(), pa.array(texts, pa.string()))]
            assert sizes == [len(shingle_set(t)) for t in texts]
