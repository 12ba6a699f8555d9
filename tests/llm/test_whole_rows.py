"""Rows with null and repeated ids in decontamination, and decoding in the pipeline."""

from tests.llm.test_operators import words


def test_clean_judges_rows_with_null_and_repeated_ids_one_by_one(spark):
    from metaloom.llm import decontaminate

    item = words(40, 9)
    items = spark.createDataFrame([(i, item if i == 1 else words(40, 100 + i)) for i in range(1, 6)], "item_id long, text string")
    good, bad = words(60, 50), words(5, 51) + " " + item
    docs = spark.createDataFrame([(None, good), (None, bad), (7, good), (7, bad), (8, None)], "doc_id long, text string").repartition(2)
    for block in (decontaminate.BLOCK_BYTES, 100):
        got = decontaminate.clean(docs, items, block_bytes=block)
        assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.where("doc_id = 8 OR NOT contains(text, '" + item + "')").collect()))


def test_coding_stage_decodes(spark, monkeypatch):
    import corpus_pipeline
    from metaloom.llm import pieces

    docs = spark.createDataFrame([(1, "one  two \u2581 \u65e5"), (2, None), (3, "")], "doc_id long, text string")
    rows = corpus_pipeline.coding_stage(spark, docs, "").collect()
    assert len(rows) == 3 and all(r["lossless"] and r["n_pieces"] == len(r["ids"] or ()) for r in rows)
    real = pieces.decode
    monkeypatch.setattr(pieces, "decode", lambda coded, *a, **b: real(coded.selectExpr("* EXCEPT (ids)", "slice(ids, 1, size(ids) - 1) AS ids"), *a, **b) if "ids" in coded.columns else real(coded, *a, **b))
    assert [r["lossless"] for r in corpus_pipeline.coding_stage(spark, docs.where("doc_id = 1"), "").collect()] == [False]
