"""The pipeline on empty tables, repeated rows, null ids, tables without languages, and columns with inner names."""

import pytest

from tests.llm.test_operators import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__own` int, `__squeezed` string, `__nr` long, node string"


def written(spark, path, rows, items=()):
    spark.createDataFrame([(*r, "s", 1, 7, "q", 8, "n") for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_every_stage_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    d = written(spark, tmp_path, [])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0
    assert corpus_pipeline.run(spark, d).count() == 0


def test_repeated_rows_null_ids_and_columns_with_inner_names(spark, tmp_path):
    import corpus_pipeline

    item = words(30, 5)
    rows = [(i, words(60, i, "abcde" if i % 2 else "vwxyz"), ["zz", "aa"][i % 2]) for i in range(40)]
    rows += [rows[3], (None, rows[4][1], "zz"), (None, words(60, 70, "vwxyz"), "zz"), (50, item, "zz"), (51, None, None)]
    d = written(spark, tmp_path, rows, [(1, item)])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted([*map(str, range(40)), "None"]) and all(r["lossless"] for r in got)


@pytest.mark.parametrize("lang", [None])
def test_without_languages_no_document_is_rejected(spark, tmp_path, lang):
    import corpus_pipeline

    d = written(spark, tmp_path, [(i, words(60, i), lang) for i in range(12)])
    assert corpus_pipeline.run(spark, d).count() == 12


def test_token_cache_is_used_again_and_keeps_versions_apart(spark, tmp_path, monkeypatch):
    import public_tokenizers

    from metaloom.llm import token_counts

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    docs = spark.createDataFrame([(i, f"text {i % 5}") for i in range(20)], "doc_id long, text string")
    stored = lambda: spark.read.schema(token_counts.CACHE).parquet(cache).groupBy("version").count().collect()
    first = sorted(token_counts.token_counts(docs, path, cache).collect())
    assert [r["count"] for r in stored()] == [5] and sorted(token_counts.token_counts(docs, path, cache).collect()) == first
    assert [r["count"] for r in stored()] == [5]
    monkeypatch.setattr(token_counts, "version_of", lambda p: "other")
    assert sorted(token_counts.token_counts(docs, path, cache).collect()) == first and [r["count"] for r in stored()] == [5, 5]
