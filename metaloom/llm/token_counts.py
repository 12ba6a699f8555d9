"""Token counts through a digest cache: only texts without a stored count are encoded."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, staged
from .pieces import counter

LIMIT = 4096
CACHE = "digest binary, version string, n_tokens long"


def version_of(path: str) -> str:
    """Digest of a tokenizer file: counts of another version are never taken."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_bytes, n_tokens, over_limit.

    Content is normalised to the UTF-8 bytes of the text, null as empty: any further folding would change
    counts. Its SHA-256 and the tokenizer's digest are joined to the Parquet cache; of each missing digest
    one row's text is encoded, and the counts are appended to the cache. Texts move once, to the tasks
    that encode them, or not at all where the missing ones are few enough for the planner to broadcast their ids. Without a cache folder, a new one is made
    beside the session's checkpoints.

    Null or empty text: 0 bytes, 0 tokens. Null and repeated ids: a row each. Equal texts: one row's is encoded, and each
    digest is stored once even where whole rows repeat.
    Very long texts are counted whole. Empty table: no rows, and nothing appended. Extra columns are ignored.
    """
    spark, version = docs.sparkSession, version_of(path)
    cache = cache or f"{shared_folder(spark)}/token-cache/{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    keys = staged(texts.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "token-keys")

    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
    wanted = keys.groupBy("digest").agg(F.min("id").alias("id"))
    missing = staged(wanted.join(known, "digest", "left_anti"), "token-missing")
    pick = missing.select(F.col("digest").alias("want"), F.col("id").alias("want_id"))
    chosen = texts.join(pick, (F.col("digest") == F.col("want")) & F.col("id").eqNullSafe(F.col("want_id"))).select("digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n = pa.array([count(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.string()), n], names=["digest", "version", "n_tokens"])

    chosen.mapInArrow(run, CACHE).dropDuplicates(["digest"]).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(staged(counts, "token-counts"), "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
