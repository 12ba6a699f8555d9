"""Word hashes of many texts at once: equal exactly for equal words."""

import random

import numpy as np

from metaloom.llm import words


def test_hashes_are_those_of_the_words(monkeypatch):
    r = random.Random(2)
    texts = [b"", b" \t", b"one", " é  日本\n\x0bA".encode(), b"x" * 900, bytes(range(256))] + [b" ".join(bytes(r.choice(b"abC\xc3") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 50))) + b" " * r.randint(0, 2) for _ in range(80)]
    for fold in (None, words.LOWER):
        want = [t.translate(fold).split() if fold else t.split() for t in texts]
        h, sizes = words.word_hashes(texts, fold)
        assert sizes.tolist() == [len(w) for w in want]
        flat = [x for w in want for x in w]
        assert len(set(flat)) == len(set(zip(flat, h.tolist(), strict=True))) == len(set(h.tolist()))
        monkeypatch.setattr(words, "PIECE", 64)
        assert (words.word_hashes(texts, fold)[0] == h).all()
        monkeypatch.undo()
    assert words.word_hashes([])[0].dtype == np.uint64 and len(words.word_hashes([b""])[1]) == 1
