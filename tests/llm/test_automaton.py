"""The automaton over numbers of words: against a plain search, and its size."""

import random

from metaloom.llm import decontaminate


def plain(text, items, window):
    words, hit, found = decontaminate.words_of(text), set(), set()
    for item_id, item in items:
        own = decontaminate.words_of(item)
        n = min(window, len(own))
        for k in range(len(own) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(item_id)
    return len(words), len(hit), sorted(found)


def test_scans_equal_a_plain_search():
    r = random.Random(5)
    for alphabet in ("ab", "abcd", "abcdefghijklmnopqr"):
        items = [(f"i{k}", " ".join(r.choices(alphabet, k=r.randint(0, 9))).encode()) for k in range(12)]
        search = decontaminate.automaton(items, 4)
        for _ in range(40):
            text = " ".join(r.choices(alphabet + "X9", k=r.randint(0, 60))).encode()
            n, runs, found, spans = decontaminate._scan(text, search)
            assert (n, sum(x["b"] - x["a"] for x in runs), found) == plain(text, items, 4)
            assert all(text.decode()[x["start"] : x["end"]].strip() == text.decode()[x["start"] : x["end"]] for x in spans)


def test_no_items_no_automaton():
    assert decontaminate.automaton([("a", b""), ("b", b" .,! ")], 13) is None
    assert decontaminate._scan(b"some words", None) == (2, [], [], [])


def test_a_block_of_items_fits_a_worker():
    """Random words share no beginnings, so that nodes are as many as can be."""
    r = random.Random(1)
    vocabulary = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(30000)]
    items = [(str(k), " ".join(r.choices(vocabulary, k=60)).encode()) for k in range(decontaminate.BLOCK_BYTES // 450)]
    made, _ = decontaminate.automaton(items, decontaminate.WINDOW)
    assert made.get_stats()["total_size"] < 150e6
