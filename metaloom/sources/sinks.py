"""Partitioned sinks with a manifest (A15-A17), and repository tables read from a database in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut

_MANIFEST = "_manifest"


def write_ordered(df: DataFrame, path: str, columns: list[str], order: list[str], kind: str = "json") -> DataFrame:
    """One folder for each value of the columns, its rows in order, and the manifest (columns, rows, first, last) of what was written.

    Folders of values that df has are replaced, others stay; df without rows writes nothing. A value's rows are dealt out by ranges of the order, so that a large one becomes several files, whose names rise with the order. The
    manifest is a folder of its own beside them, replaced as a whole: its numbers are of this write.
    """
    rows = cut(df, "sink")
    keys = [F.col(c) for c in columns]
    first = F.struct(*order)
    manifest = rows.groupBy(*columns).agg(F.count("*").alias("rows"), F.to_json(F.min(first)).alias("first"), F.to_json(F.max(first)).alias("last"))
    if rows.isEmpty():
        return manifest
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    writer = dealt.write.mode("overwrite").partitionBy(*columns).option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false")
    writer.format(kind).save(path)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/{_MANIFEST}")  # a row for each folder
    return manifest


def read_ordered(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """What write_ordered wrote, without its manifest, whose name readers pass over."""
    return spark.read.schema(schema).format(kind).load(path)


def checked(written: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """(columns, rows, found, whole): rows that the manifest of a write gives for each folder against those that are there."""
    spark = written.sparkSession
    names = ", ".join(f"{c} {written.schema[c].dataType.simpleString()}" for c in columns)
    told = spark.read.schema(f"{names}, rows long").json(f"{path}/{_MANIFEST}")
    there = written.groupBy(*columns).agg(F.count("*").alias("found"))
    joined = told.join(there.select(*(F.col(c).alias(f"__{c}") for c in columns), "found"), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns], "left")
    return joined.select(*columns, "rows", F.coalesce("found", F.lit(0)).alias("found"), (F.col("rows") == F.coalesce("found", F.lit(0))).alias("whole"))


def database_table(spark: SparkSession, url: str, table: str, column: str | None = None, rows_a_part: int = 1_000_000, options: dict[str, str] | None = None) -> DataFrame:
    """A table of a database, read in parts of about rows_a_part by ranges of an integer column, whose bounds and number the table itself is asked for.

    Without a column, with few rows or with none: one part. Null values of the column are read with the first part.
    """
    reader = lambda: spark.read.format("jdbc").option("url", url).options(**(options or {}))
    if column is None:
        return reader().option("dbtable", table).load()
    asked = f"(SELECT MIN({column}) AS low_v, MAX({column}) AS high_v, COUNT(*) AS n_v FROM {table}) bounds"
    low, high, n = reader().option("dbtable", asked).load().toDF("low", "high", "n").first()  # one row
    parts = -(-n // rows_a_part)
    if low is None or low == high or parts < 2:
        return reader().option("dbtable", table).load()
    return reader().option("dbtable", table).option("partitionColumn", column).option("lowerBound", int(low)).option("upperBound", int(high) + 1).option("numPartitions", parts).load()


def database_repository(spark: SparkSession, url: str, tables: dict[str, str | None], prefix: str = "", rows_a_part: int = 1_000_000, options: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Repository tables by name, each with the column that its parts go by (or None); prefix: the schema with its dot."""
    return {name: database_table(spark, url, f"{prefix}{name}", column, rows_a_part, options) for name, column in tables.items()}
