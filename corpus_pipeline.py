"""Corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, SentencePiece coding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written and read again as the next
stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm import decontaminate, exact_dedup, language_id, near_dedup, pieces
from metaloom.llm.common import held_out, staged, table, with_ids

#: A language's share of the probability below which a document is rejected.
LANGUAGE_SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is undecided.

    Null or empty text: dropped. Where no document has a lang, nothing can be learned and every row stays. Null and
    repeated ids: a row each; which rows are learned from hangs on the id. Very long texts are coded whole. Ties go to
    the first language by name. Empty table: no rows. Extra columns are kept, whatever their names.
    """
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    return language_id.accepted(docs, model, LANGUAGE_SHARE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: most code points, then smallest id, a null id last.

    Null text: as empty. Rows that share an id are told apart by their texts; of rows that repeat both, one stays. Empty
    table: no rows. Extra columns are kept, whatever their names.
    """
    return exact_dedup.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of near copies (five words, similarity 0.8).

    Null or empty text, and null ids: linked with nothing, kept. Rows that repeat an id are one document: all or none
    stay. Very long texts use all their shingles. Empty table: no rows. Extra columns are kept, whatever their names.
    """
    kept = near_dedup.near_groups(docs).where("kept").select("doc_id")
    return with_ids(docs, kept)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more lies in benchmark windows, each row by its own text.

    Null or empty text: kept. An empty benchmark, or items without words: all rows stay. Null and repeated ids: a row
    each. Empty table: no rows. Extra columns are kept, whatever their names.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def coding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, drawn by seeded merge-dropout, and whether decoding them gives its text back.

    Null text: null ids, 0 pieces, lossless. Empty text: no ids. Null id: keyed as ''. Repeated rows: equal ids. Very
    long texts are coded whole. Empty table: no rows. A column of docs named `original` is set aside by this stage.
    """
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(docs.withColumn("original", F.col("text")), path, carry=("original",))
    back = pieces.decode(coded.withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)).cast("long")), path, carry=("n_pieces", "ids", "original"))
    return back.select("doc_id", "n_pieces", "ids", F.col("text").eqNullSafe(F.col("original")).alias("lossless"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("sentencepiece", coding_stage),
]

#: Language models, MinHash and piece coding can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
