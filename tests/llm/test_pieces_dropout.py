"""Merge-dropout is drawn for each occurrence of a run, not once for the corpus."""

import random
import time
from itertools import pairwise

import numpy as np
import pytest

from metaloom.llm import pieces

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")
TEXT = "the international conference on parallel segmentation of unusual sentences was postponed"


def ids(raw):
    return tuple(np.frombuffer(raw, np.int32).tolist())


def test_copies_of_a_text_are_drawn_apart():
    codec = pieces.Codec(MODEL)
    coded = [ids(x) for x in codec.encode_many([TEXT] * 1000, [str(i) for i in range(1000)])]
    assert len(set(coded)) > 400 and all(codec.decode(x).decode() == TEXT for x in coded)
    plain = ids(pieces.Codec(MODEL, 0.0).encode_many([TEXT], [""])[0])
    skipless = 0.9 ** sum(int(codec.taken[codec.root[run]]) for run in pieces.runs(TEXT))
    assert abs(sum(x == plain for x in coded) / 1000 - skipless) < 0.02


def test_a_merge_is_dropped_in_a_tenth_of_its_occurrences():
    codec, n = pieces.Codec(MODEL), 40000
    run = next(r for r in "abcdefghijklmnopqrstuvwxyz" if codec._segment(r, iter(()))[1] == 1)
    text = " ".join([run] * n)
    merged = sum(1 for i in ids(codec.encode_many([text], ["7"])[0]) if i == codec.segment(run)[0])
    assert abs(1 - merged / n - 0.1) < 0.01
    places = [codec.segment(run, int(d)) != codec.segment(run) for d in codec._draws("7", n)]
    assert abs(sum(a and b for a, b in pairwise(places)) / n - 0.01) < 0.004


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_batches_and_caches_change_nothing(dropout, monkeypatch):
    """Each occurrence equals a segmentation by itself, with long runs, marks, and a cache emptied all the time."""
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("aeinrst▁é日") for _ in range(r.randint(0, 40))) for _ in range(30)) for _ in range(40)] + [TEXT, "", "  a "]
    keys = [str(i) for i in range(len(texts))]
    codec = pieces.Codec(MODEL, dropout)
    coded = codec.encode_many(texts, keys)
    for text, key, raw in zip(texts, keys, coded, strict=True):
        each = pieces.runs(text) if text else []
        assert ids(raw) == tuple(i for run, d in zip(each, codec._draws(key, len(each)), strict=True) for i in codec.segment(run, int(d)))
    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 0)
    assert [codec.encode_many([t], [k])[0] for t, k in zip(texts, keys, strict=True)] == coded


def listed(codec, run, skips):
    """The agenda as a plain list: the best offer, leftmost first, is sought anew for each candidate."""
    symbols, dropped, taken = [pieces.MARK, *run], set(), 0
    places = list(range(len(symbols)))
    while True:
        offers = [(codec.rank[a + b], k) for k, (a, b) in enumerate(pairwise(symbols)) if a + b in codec.rank and (places[k], a, b) not in dropped]
        if not offers:
            return tuple(codec.piece[s] for s in symbols), taken
        k = min(offers)[1]
        taken += 1
        if taken - 1 in skips:
            dropped.add((places[k], symbols[k], symbols[k + 1]))
            continue
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        del places[k + 1]


def test_long_runs_equal_a_plain_search():
    codec, r = pieces.Codec(MODEL), random.Random(12)
    for alphabet in ("aeinrst", "a", "ab", "theinorgs"):
        for _ in range(12):
            run = "".join(r.choice(alphabet) for _ in range(r.randint(30, 120)))
            skips = sorted(r.sample(range(80), r.randint(0, 20)))
            assert codec._segment(run, iter(skips)) == listed(codec, run, set(skips))


@pytest.mark.parametrize("run", ["abcdefghij" * 20_000, "a" * 200_000, "".join(random.Random(3).choices("ABCDEFabcdef0123456789+/", k=200_000))])
def test_a_run_of_200000_characters_is_coded_in_seconds(run):
    codec, began = pieces.Codec(MODEL), time.process_time()
    coded = codec.encode_many([run, f"x {run[:1000]}"], ["1", "2"])
    assert time.process_time() - began < 20
    assert [codec.decode(ids(x)).decode() for x in coded] == [run, f"x {run[:1000]}"]
    assert pieces.counter(MODEL)(run) == len(pieces.Codec(MODEL, 0.0).encode(run))
