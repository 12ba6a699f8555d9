"""Word 2-gram scores against a direct count."""

import math
import random
from collections import Counter

import pytest

from metaloom.llm import lm_score


def micro(share):
    return round(math.log(share) * lm_score.UNIT)


def brute(texts):
    """Each text scored by the counts of all others."""
    words = [(t or "").encode().lower().split() for t in texts]
    pairs = [list(zip([b"", *w], w, strict=False)) for w in words]
    all1, all2, total = Counter(), Counter(), sum(map(len, words))
    for w, p in zip(words, pairs, strict=True):
        all1.update([b""] * bool(w) + w)
        all2.update(p)

    def score(w, p):
        own1, own2 = Counter([b"", *w]), Counter(p)
        n1, n2 = (lambda x: all1[x] - own1[x]), (lambda x: all2[x] - own2[x])
        back = micro(max(1, total - len(w)))
        return sum(micro(n2(x) / n1(x[0])) if n2(x) else micro(lm_score.DISCOUNT * max(1, n1(x[1]))) - back for x in p)

    return [(len(w), score(w, p)) for w, p in zip(words, pairs, strict=True)]


@pytest.mark.parametrize("chunk", [6_000_000, 200])
def test_scores_follow_rare_words_and_word_order(spark, monkeypatch, chunk):
    """Also with texts longer than a chunk, and n-grams in several batches."""
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm_score, "BATCH_ROWS", chunk)
    r = random.Random(4)
    texts = ["a b c a b", "b a c b a", "A  b\tzyx", "", None, "a b c a b", " \n ", "once", "x " * 300]
    texts += [" ".join(r.choice(["de", "fg", "hi", "jk", f"w{r.randint(0, 40)}"]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    rows = [(i if i != 5 else 0, t) for i, t in enumerate(texts)] + [(None, "a b")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, nr int, gram string, n int").repartition(3)
    got = lm_score.lm_scores(docs).collect()
    want = sorted((str(i), *x) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True))
    assert sorted((str(x["doc_id"]), x["n_grams"], x["log_score"]) for x in got) == want
    assert all((x["mean_log"] is None) == (x["n_grams"] == 0) for x in got)
    assert lm_score.lm_scores(docs.limit(0)).count() == 0


def test_a_document_alone_backs_off_to_one_of_one(spark):
    docs = spark.createDataFrame([(1, "p q p q")], "doc_id long, text string")
    assert lm_score.lm_scores(docs).collect()[0]["log_score"] == 4 * micro(lm_score.DISCOUNT)


def test_the_table_holds_every_ngram_with_its_counts(spark):
    """Those of one document too, and of a small corpus."""
    texts = ["a b a b c", "c a b", "only here", ""]
    table, total = lm_score.count_tables(spark.createDataFrame([(t.encode(),) for t in texts], "text binary").repartition(2))
    pairs = Counter(p for t in texts for p in zip(["", *t.split()], t.split(), strict=False))
    words = Counter(w for t in texts for w in ["", *t.split()][not t :])
    got = table.collect()
    assert sorted((x["n"], x["in_a"], x["of_b"]) for x in got) == sorted((n, words[a], words[b]) for (a, b), n in pairs.items())
    assert len({(x["a"], x["b"]) for x in got}) == len(pairs) and total == 10


def test_a_text_that_occurs_twice_scores_above_one_that_occurs_once(spark):
    r = random.Random(6)
    texts = [" ".join(f"w{int(r.paretovariate(0.6)) % 5000}" for _ in range(200)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[3], texts[8]])), "doc_id long, text string")
    score = {x["doc_id"]: x["mean_log"] for x in lm_score.lm_scores(docs).collect()}
    twice = {3, 8, 40, 41}
    assert min(score[i] for i in twice) > max(v for i, v in score.items() if i not in twice)
