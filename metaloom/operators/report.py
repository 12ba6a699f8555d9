"""Report derivations (family J) over orders and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def market_code(segment: str = "c_mktsegment"):
    """A code map with a default."""
    s = F.col(segment)
    return F.when(s == "BUILDING", "B").when(s == "AUTOMOBILE", "A").when(s == "MACHINERY", "M").otherwise("X")


def enriched(orders: DataFrame, customers: DataFrame, nations: DataFrame) -> DataFrame:
    """Lookups on one key; a missing or blank name falls back to another derivation."""
    right = customers.dropDuplicates(["c_custkey"]).join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    out = orders.join(right, F.col("o_custkey") == F.col("c_custkey"), "left")
    name = F.coalesce(F.nullif(F.trim("c_name"), F.lit("")), F.concat(F.lit("CUST_"), F.col("o_custkey").cast("string")))
    return out.select("o_orderkey", market_code().alias("market"), name.alias("client"), F.coalesce("n_name", F.lit("UNKNOWN")).alias("country"))


def flag_class(first, second):
    """1 to 4 by two flags."""
    return F.when(first & second, 1).when(first, 2).when(second, 3).otherwise(4)


def fixed_amount(amount, rate, width: int = 16):
    """Converted, two decimals, no dot, padded with zeros; whole cents, so that no engine rounds otherwise."""
    cents = F.floor(amount * rate * 100 + 0.5).cast("long")
    return F.lpad(cents.cast("string"), width, "0")


def report_lines(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Wide rows to (key, code, value)."""
    return rows.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([key], columns, "code", "value")


def validated(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A flag, and the comments of the checks that failed in their order."""
    comments = F.concat_ws("; ", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in checks.items()])
    return rows.withColumn("comments", comments).withColumn("is_valid", F.when(F.col("comments") == "", "Y").otherwise("N"))
