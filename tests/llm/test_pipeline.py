"""The pipeline against brute force over a small table, and the registered queries against their SQL."""

import pytest

from tests.compare import assert_same
from tests.llm.test_operators import near_components, words

DATA = "/root/testdata/sf0.001"


def test_pipeline_keeps_the_rows_that_brute_force_keeps(spark, tmp_path):
    import corpus_pipeline
    from metaloom.llm.decontaminate import words_of

    item = words(30, 77)
    texts = [words(80, i, "abcde" if i % 2 else "vwxyz") for i in range(60)]
    texts += [texts[3], texts[4] + "  ", texts[5] + " more", "12 34", None, item, words(80, 99) + " " + item, texts[7] + "\n"]
    rows = [(i, t, ["zz", "aa"][i % 2], "s", 1) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    live = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    groups = {}
    for i in live:
        groups.setdefault("".join(texts[i].split()), []).append(i)
    live = sorted(min(g, key=lambda i: (-len(texts[i]), i)) for g in groups.values())
    label = near_components([texts[i] for i in live], 5)
    live = [i for k, i in enumerate(live) if label[k] == k]
    windows = {tuple(words_of(item.encode())[i : i + 13]) for i in range(18)}

    def clean(i):
        w = words_of(texts[i].encode())
        hit = {j for s in range(len(w) - 12) if tuple(w[s : s + 13]) in windows for j in range(s, s + 13)}
        return not hit or 20 * len(hit) < len(w)

    assert got == {i for i in live if clean(i)}


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_sharding", "op5_decontaminate", "op6_lm_score", "op7_near_dedup", "op8_substring_dedup"])
def test_queries_match_their_sql(spark, name):
    from metaloom.llm import entry

    assert assert_same(entry.queries()[name](spark, DATA), entry.oracle_sql()[name], "sf0.001") == 200
