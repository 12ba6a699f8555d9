"""Each corpus operator on a small table with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloom.llm import common, decontaminate, exact_dedup, language_id, near_dedup, pieces, quality, sharding, substring_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, h string, id long, key string, kept boolean, node long"
P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")


def words(n, seed, alphabet="abcdefgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, 6))) for _ in range(n))


def edited(text, places):
    w = text.split()
    for i in places:
        w[i] = f"edit{i}"
    return " ".join(w)


BASE = words(200, 1)
TEXTS = [
    BASE, BASE, BASE + " \n", BASE.upper(), edited(BASE, [5]), edited(BASE, [5, 90]), edited(BASE, range(0, 200, 3)), None, None, "", " \t ", "one", "one two", "日本語 テスト", "a  b   c ", "▁x ▁ y",
    words(6000, 2), words(60, 3) + " " + " ".join(BASE.split()[20:80]), "12 34 !!", "x " * 500, words(30, 4) + " " + words(30, 4),
]
ROWS = [(i, t, "en" if i % 2 else "fr", "s" if i % 3 else None, "x", i, "k", True, 1) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def messy(spark):
    """Also null ids, and rows that repeat."""
    return spark.createDataFrame([*ROWS, ROWS[0], (None, BASE, None, None, "x", 1, "k", True, 1), (None, None, None, None, "x", 1, "k", True, 1)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def squeezed(t):
    return "".join(c for c in t or "" if c not in common.WHITE)


def test_exact_groups(docs, messy, empty):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs).collect()}
    for i, t in enumerate(TEXTS):
        group = [j for j, u in enumerate(TEXTS) if squeezed(u) == squeezed(t)]
        keep = min(group, key=lambda j: (-len(TEXTS[j] or ""), j))
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, len(group), keep == i, hashlib.sha256(squeezed(t).encode()).hexdigest())
    rows = exact_dedup.exact_groups(messy).collect()
    assert len(rows) == len(ROWS) + 3 and {r["keep_id"] for r in rows if r["doc_id"] is None} == {2, 10}
    kept = exact_dedup.without_copies(messy)
    assert kept.columns == messy.columns and kept.count() == sum(r["kept"] for r in got.values())
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_groups_part_colliding_hashes(docs):
    weak = exact_dedup.exact_groups(docs, content_hash=lambda t: F.length(t) % 2).select("doc_id", "keep_id", "group_size")
    assert sorted(weak.collect()) == sorted(exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size").collect())


def test_shards(docs, messy, empty, spark):
    rows = sharding.shards(docs, n_shards=4).collect()
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    sizes = [sum(r["shard"] == s for r in rows) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1 and {r["doc_id"]: r["size"] for r in rows}[7] == 1
    assert sharding.shards(messy).count() == len(ROWS) + 3 and sharding.shards(empty).count() == 0
    many = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 10 < 6 THEN 'hot' ELSE concat('s', id % 3) END AS source")
    mix = sharding.shards(many).join(many.select("doc_id", "source"), "doc_id").groupBy("shard").agg(F.count_if(F.col("source") == "hot").alias("n")).collect()
    assert all(abs(r["n"] - 300) <= 2 for r in mix)


def test_language_id(messy, empty, spark):
    def text(i):
        return words(60, i, "abcde" if i % 2 else "vwxyz")

    train = spark.createDataFrame([(i, text(i), "aa" if i % 2 else "zz") for i in range(80)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    test = spark.createDataFrame([(i, text(i)) for i in range(200, 240)], "doc_id long, text string")
    assert all(r["lang_pred"] == ("aa" if r["doc_id"] % 2 else "zz") and r["score"] > 0.9 for r in language_id.identify(test, model).collect())
    got = language_id.identify(messy, model).collect()
    assert len(got) == len(ROWS) + 3
    left = language_id.accepted(messy, model, 0.0)
    assert left.columns == messy.columns and left.count() == sum(r["lang_pred"] != "und" for r in got)
    undecided = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {7, 8, 9, 10, 18} <= undecided and 13 not in undecided
    assert language_id.fit(empty) is None and language_id.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(messy, None).collect()} == {"und"}


def test_code_lengths_are_those_of_the_context_trees(monkeypatch):
    """Bits of a text by walking each language's counts directly, escape method C; the argmax and the posterior of several."""
    samples, texts = {"a": b"abracadabra abracadabra", "b": b"banana bandana", "c": b"cccc"}, [b"abrac zab", b"bandana ban", b"", "\u00e9x".encode(), b"cc" * 40]
    lang, gram, n, trees = [], [], [], {}
    for name, sample in samples.items():
        keys, times = np.unique(language_id._grams(sample), return_counts=True)
        lang += [name] * len(keys)
        gram += keys.tolist()
        n += times.tolist()
        tree = trees[name] = {}
        for k, c in zip(keys.tolist(), times.tolist(), strict=True):
            b = k.to_bytes(4, "big")
            for order in range(4):
                tree.setdefault(b[3 - order : 3], {}).setdefault(b[3:], 0)
                tree[b[3 - order : 3]][b[3:]] += c
    model = language_id.build(np.array(lang, object), np.array(gram, np.int64), np.array(n))

    def walked(tree, text):
        bits, padded = 0.0, b"\n\n\n" + text
        for i in range(len(text)):
            context, symbol = padded[i : i + 3], padded[i + 3 : i + 4]
            for order in (3, 2, 1, 0):
                seen = tree.get(context[3 - order :])
                if seen is None:
                    continue
                total, distinct = sum(seen.values()), len(seen)
                if symbol in seen:
                    bits -= np.log2(seen[symbol] / (total + distinct))
                    break
                bits -= np.log2(distinct / (total + distinct))
            else:
                bits += 8
        return bits

    want = np.array([[walked(trees[m], t) for m in model.languages] for t in texts])
    for piece in (1 << 18, 4):
        monkeypatch.setattr(language_id, "_PIECE", piece)
        assert np.abs(language_id.code_lengths(model, texts) - want).max() < 1e-3
    got = language_id.predict_many(model, [t or None for t in texts])
    for (name, score, each), row, t in zip(got, want, texts, strict=True):
        if t:
            assert name == model.languages[row.argmin()] and abs(score - 1 / np.exp2(row.min() - row).sum()) < 1e-4 and abs(each - row.min() / len(t)) < 1e-4
        else:
            assert (name, score, each) == ("und", 0.0, None)


def test_rare_languages_are_learned_too(spark):
    train = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q " * 30, f"l{i:03}") for i in range(300)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    assert len(model.languages) == 300 and all(r["lang_pred"] == f"l{r['doc_id']:03}" for r in language_id.identify(train, model).collect())


def test_quality(spark, messy, empty):
    def text(i):
        return " ".join(w + "###" if i % 3 == 0 and k % 2 else w for k, w in enumerate(words(50, i).split()))

    docs = spark.createDataFrame([(i, text(i)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(200)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    assert all((scores[i] >= quality.CUT) == (i % 3 != 0) for i in range(200, 300))
    assert all(0 <= r["score"] <= 1 for r in quality.scored(messy, model).collect()) and quality.scored(empty, model).count() == 0
    assert quality.fit(docs, labels.where("quality = 1")) is None and quality.scored(docs, None).first()["score"] == 0.5


def test_quality_ratios_and_optimum_against_plain_versions(spark):
    """Class counts by hand; the fitted weights against a primal subgradient solver of the same objective."""
    r = np.random.default_rng(3)
    texts = [words(r.integers(0, 12), i, "abc") for i in range(60)] + [None, "", words(5, 1, "abc")]
    rows = spark.createDataFrame([(t, int(i % 3 == 0)) for i, t in enumerate(texts)], "text string, label int").select(F.col("text").cast("binary").alias("text"), "label")
    got = {x["bucket"]: (x["ones"], x["zeros"]) for x in quality.class_counts(rows).collect()}
    want: dict = {}
    for i, t in enumerate(texts):
        for b in set(quality.features((t or "").encode()).tolist()):
            one = want.setdefault(b, [0, 0])
            one[0 if i % 3 == 0 else 1] += 1
    assert got == {b: tuple(x) for b, x in want.items()}

    ratio = r.normal(size=12)
    xs = [np.flatnonzero(r.random(12) < 0.4).astype(np.int32) for _ in range(80)]
    label = (np.array([ratio[x].sum() for x in xs]) + r.normal(size=80) > 0).astype(int)
    model = quality.descend(xs, label, ratio, epochs=600, mix=1.0)
    y = np.where(label == 1, 1.0, -1.0)
    cost = np.where(y > 0, 80 / (2 * (y > 0).sum()), 80 / (2 * (y < 0).sum()))
    v = np.zeros((80, 13))
    for i, x in enumerate(xs):
        v[i, x] = ratio[x] / np.sqrt(1 + (ratio[x] ** 2).sum())
    v[:, 12] = 1

    def objective(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - y * (v @ w))).sum()

    w, mean = np.zeros(13), np.zeros(13)
    for t in range(1, 60001):
        w = w - (w - ((cost * y * (y * (v @ w) < 1)) @ v)) / t
        mean += (w - mean) * 2 / (t + 1)
    fitted = objective(np.append(model.weight / ratio, model.bias))
    assert fitted <= objective(mean) + 1e-3 and abs(fitted - objective(mean)) < 1e-2 * fitted


def test_quality_is_the_same_on_any_partitioning(spark):
    docs = spark.createDataFrame([(i, words(30, i, "abcd" if i % 2 else "cdef")) for i in range(120)] + [(5, "other text"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, 0), (4, None), (None, 1)], "doc_id long, quality int")
    one, two = (quality.fit(d, m) for d, m in ((docs, labels), (docs.repartition(7), labels.repartition(5))))
    assert (one.weight == two.weight).all() and (one.bias, one.a, one.b) == (two.bias, two.a, two.b)


def test_decontaminate(spark, messy, empty):
    item = words(40, 9)
    items = spark.createDataFrame([(1, item), (2, "short one here"), (3, None), (4, ""), (5, item)], "item_id long, text string")
    texts = {1: words(20, 10) + " " + " ".join(item.split()[10:30]) + ". " + words(10, 11), 2: "A Short, ONE! here and more", 3: words(300, 12) + " short one here", 4: " ".join(item.split()[:12]), 5: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 100):
        got = {r["doc_id"]: r for r in decontaminate.verdicts(decontaminate.benchmark_hits(docs, items, block_bytes=block)).collect()}
        assert [got[i]["n_hit"] for i in (1, 2, 3, 4, 5)] == [20, 3, 3, 0, 0]
        assert got[1]["items"] == ["1", "5"] and [got[i]["contaminated"] for i in (1, 2, 3)] == [True, True, False]
        span = got[2]["spans"][0]
        assert texts[2][span["start"] : span["end"]] == "Short, ONE! here"
        assert [r["doc_id"] for r in decontaminate.clean(docs, items, block_bytes=block).orderBy("doc_id").collect()] == [3, 4, 5]
    assert decontaminate.benchmark_hits(messy, items).count() == len(ROWS) + 3 and decontaminate.clean(messy, items).columns == messy.columns
    assert decontaminate.benchmark_hits(empty, items).count() == 0 and decontaminate.benchmark_hits(messy, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def shingle_set(t, width):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_components(texts, width):
    sets, label = [shingle_set(t, width) for t in texts], list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(range(len(texts)), 2):
        x, y = len(sets[a]), len(sets[b])
        if min(x, y) * 100 >= 80 * max(x, y, 1) and 100 * (both := len(sets[a] & sets[b])) >= 80 * (x + y - both):
            a, b = root(a), root(b)
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("width", [4, 5])
def test_near_groups(docs, messy, empty, width):
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs, width=width).collect()}
    assert [got[i] for i in range(len(TEXTS))] == near_components(TEXTS, width)
    rows = near_dedup.near_groups(messy, width=width).collect()
    assert len(rows) == len(ROWS) + 3 and all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert near_dedup.near_groups(empty).count() == 0


def test_near_groups_in_one_large_family(spark):
    """Hundreds of edits of one text at all similarities: blocks must find each link and no other."""
    r = random.Random(5)
    texts = [edited(BASE, r.sample(range(200), r.randint(1, 14))) for _ in range(250)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_groups(docs, width=4).collect()}
    assert [got[i] for i in range(len(texts))] == near_components(texts, 4)


@pytest.mark.parametrize("bits", [(), (5, 7)])
def test_substring_dedup(docs, messy, empty, bits):
    """Also where windows of different words share a hash at first."""
    cut = substring_dedup.without_repeats(docs, substring_dedup.repeated_spans(docs, hash_bits=bits)).collect()
    seen, want = set(), {}
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            gone |= set(range(s, s + 20)) if k in seen else set()
            seen.add(k)
        want[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in cut} == want
    rows = substring_dedup.without_repeats(messy, substring_dedup.repeated_spans(messy)).collect()
    assert len(rows) == len(ROWS) + 3 and {r["n_removed"] for r in rows if r["doc_id"] in (0, None)} == {0}
    assert substring_dedup.without_repeats(empty, substring_dedup.repeated_spans(empty)).count() == 0


def test_pieces_round_trip(messy, empty):
    coded = pieces.encode(messy, MODEL, carry=("h",))
    back = pieces.decode(coded, MODEL, carry=("h",))
    assert sorted(map(str, (r["text"] for r in back.collect()))) == sorted(map(str, (r["text"] for r in messy.collect())))
    assert back.columns == ["doc_id", "text", "h"] and pieces.encode(empty, MODEL).count() == 0
    again = {(r["doc_id"], tuple(r["ids"] or ())) for r in pieces.encode(messy.repartition(7), MODEL).collect()}
    assert again == {(r["doc_id"], tuple(r["ids"] or ())) for r in coded.collect()}


def test_pieces_follow_the_library_without_dropout_and_vary_with_it():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(3)
    texts = [t for t in TEXTS if t and "▁" not in t] + ["".join(r.choice(" aeb\n<>é日.0") for _ in range(r.randint(1, 60))) for _ in range(500)]
    plain, varied = pieces.Codec(MODEL, 0.0), pieces.Codec(MODEL)
    assert [np.frombuffer(x, np.int32).tolist() for x in plain.encode_many(texts, [""] * len(texts))] == sp.encode(texts)
    assert [plain.encode(t) for t in texts[:30]] == sp.encode(texts[:30])
    assert all(varied.decode(varied.encode(t, "k")).decode() == t for t in texts)
    assert len({tuple(varied.segment("international", v)) for v in range(40)}) > 5
    for v in range(varied.variants):
        assert all(np.array(varied.segment(run, v), np.int32).tobytes() == ids for run, ids in list(varied.held[v].items())[:500])


def test_token_counts(messy, empty, tmp_path):
    import sentencepiece

    sp, cache = sentencepiece.SentencePieceProcessor(model_file=MODEL), str(tmp_path / "cache")
    got = token_counts.token_counts(messy, MODEL, cache, limit=100).collect()
    text = dict(enumerate(TEXTS))
    assert len(got) == len(ROWS) + 3
    assert all(r["n_tokens"] == len(sp.encode(text[r["doc_id"]] or "")) and r["over_limit"] == (r["n_tokens"] > 100) for r in got if r["doc_id"] is not None)
    read = messy.sparkSession.read.schema(token_counts.CACHE).parquet(cache)
    stored = read.count()
    assert stored == len({t or "" for t in TEXTS})
    token_counts.token_counts(messy, MODEL, cache).count()
    assert messy.sparkSession.read.schema(token_counts.CACHE).parquet(cache).count() == stored
    assert token_counts.token_counts(empty, MODEL, str(tmp_path / "none")).count() == 0
