"""Sharding: proportional stratified interleaving by fractional rank."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc32_sql, staged

SEED = "interleave-1"
SHARDS = 8
#: Rows that one ranking task should hold; the number of hash ranges follows from it.
ROWS_PER_RANGE = 1_000_000


def shards(docs: DataFrame, n_shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Rows are put in a seeded hash order within each source; rank r of n gets the fraction (r - 1/2) / n.
    The order by fraction is cut into n_shards runs whose row counts differ by one at most, so that
    every run holds each source in proportion. Both rankings are made in hash ranges (of the key, then
    of the fraction) with prefix sums of the ranges' counts, so no source and no run is sorted in one task.

    One task holds the counts of a source's hash ranges (a row for each million rows), another those of all runs of 256.

    Null or empty text: size 1, checksum 0. Null source: a source of its own. Null id: hashed as ''.
    Ties of the hash go by id, then checksum; equal rows are interchangeable. Fewer rows than shards:
    some shards get none. Empty table: no rows. Extra columns are ignored.
    """
    text, doc_id = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    base = staged(docs.select(
        doc_id.alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("src"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))).alias("key"),
    ), "shard-rows")
    total = base.count()
    digits = max(2, math.ceil(math.log(max(total, 1) / ROWS_PER_RANGE + 1, 16)) + 1)
    base = base.withColumn("part", F.substring("key", 1, digits))

    parts = base.groupBy("src", "part").agg(F.count("*").alias("n"))
    of_source = Window.partitionBy("src")
    parts = parts.select("src", "part", (F.sum("n").over(of_source.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(of_source).alias("n_source"))
    order = [F.col("key"), F.col("doc_id"), F.col("text_crc32")]
    within = F.row_number().over(Window.partitionBy("src", "part").orderBy(*order))
    fraction = (F.col("before") + F.col("rn") - 0.5) / F.col("n_source")
    ranked = base.withColumn("rn", within).join(staged(parts, "shard-parts"), ["src", "part"]).withColumn("fraction", fraction)
    ranked = staged(ranked.withColumn("run", F.floor(F.col("fraction") * 16**digits)).drop("src", "part", "rn", "before", "n_source"), "shard-ranked")

    runs = ranked.groupBy("run").agg(F.count("*").alias("n"))
    coarse = F.floor(F.col("run") / 256)
    tops = runs.groupBy(coarse.alias("top")).agg(F.sum("n").alias("m"))
    tops = tops.select("top", (F.sum("m").over(Window.orderBy("top")) - F.col("m")).alias("before_top"))
    runs = runs.withColumn("top", coarse).join(tops, "top").select("run", (F.col("before_top") + F.sum("n").over(Window.partitionBy("top").orderBy("run")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("run").orderBy("fraction", *order))
    placed = ranked.withColumn("rn", place).join(staged(runs, "shard-runs"), "run").withColumn("at", F.col("before") + F.col("rn") - 1)
    shard = F.expr(f"(at * {n_shards}) div {max(total, 1)}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"at - (shard * {total}L + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


ORACLE = f"""
WITH {CRC_TABLE_SQL},
t AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hx, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY source) AS fraction, count(*) OVER () AS total FROM t),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, key, doc_id) - 1 AS place FROM r)
SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, CAST({crc32_sql("hx")} AS BIGINT) AS text_crc32, 'rows' AS law,
CAST((place * {SHARDS}) // total AS INTEGER) AS shard, CAST(place - (((place * {SHARDS}) // total) * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p, crc_table
"""
