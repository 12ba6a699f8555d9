"""Helpers shared by the corpus operators: reading, staging, ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.sources.store import shared_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: ASCII white space that the contracts strip or split on.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one made from it that no column of df bears."""
    while name in df.columns:
        name += "_"
    return name


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again.

    Cuts the lineage so that a lost executor costs a reread, not a recompute, and gives the planner
    the true size, so that a join broadcasts a small side only when it is known to be small.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # the written table replaces the job's shuffle files
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def with_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows of docs whose id is (or, with left_anti, isn't) among the ids; null meets null."""
    own = ids.select(F.col(ids.columns[0]).alias("__own")).distinct()
    return docs.join(own, docs[id_col].eqNullSafe(own["__own"]), how)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4) == 2


#: DuckDB CTE with the 256 remainders of CRC-32, from its polynomial.
CRC_TABLE_SQL = "crc_table AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY n) AS crc FROM (SELECT unnest(range(256)) AS n))"


def crc32_sql(hex_col: str) -> str:
    """DuckDB CRC-32 of the bytes in a hex column, beside the column crc of crc_table."""
    data = f"list_transform(range(CAST(length({hex_col}) // 2 AS BIGINT)), lambda i: CAST(concat('0x', substr({hex_col}, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295)"
