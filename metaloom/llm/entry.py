"""Registered queries of the corpus operators, each over its whole table, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation, decontaminate, exact_dedup, language_id, lm_score, near_dedup, pieces, quality, sharding, substring_dedup, token_counts, url_filter, whitening
from .common import held_out, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kept = ~held_out(F.col("doc_id"))
    scores = quality.scored(docs, quality.fit(docs.where(kept), labels.where(kept)))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    return language_id.identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.verdicts(hits).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), width=4)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = substring_dedup.without_repeats(docs, substring_dedup.repeated_spans(docs))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes with merge-dropout, decodes again, and tells whether each text came back."""
    docs = table(spark, sf_dir, "documents").withColumn("text_md5", F.md5("text"))
    coded = pieces.encode(docs, _model(), carry=("text_md5",))
    coded = coded.withColumns({"n_pieces": F.coalesce(F.size("ids"), F.lit(0)).cast("long"), "ids_digest": F.xxhash64("ids")})
    back = pieces.decode(coded, _model(), carry=("text_md5", "n_pieces", "ids_digest"))
    return back.select("doc_id", "n_pieces", "ids_digest", F.md5("text").eqNullSafe(F.col("text_md5")).alias("lossless"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _model())


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversation.reports(conversation.repair(conversation.damaged(given)), given)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_exact_dedup, op2_sharding, op3_quality, op4_language_id, op5_decontaminate, op6_lm_score, op7_near_dedup, op8_substring_dedup, op9_sentencepiece, op10_token_counts, op11_url_filter, op12_conversation_repair, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op2_sharding": sharding.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op6_lm_score": lm_score.ORACLE, "op7_near_dedup": near_dedup.oracle(4, near_dedup.THRESHOLD), "op8_substring_dedup": substring_dedup.ORACLE, "op11_url_filter": url_filter.ORACLE}
