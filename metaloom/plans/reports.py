"""Queries of the report derivations, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import report


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def j02(spark, d):
    return report.enriched(_t(spark, d, "orders"), _t(spark, d, "customer"), _t(spark, d, "nation"))


def j03(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", report.flag_class(F.col("l_returnflag") == "R", F.col("l_linestatus") == "F").alias("class"), report.fixed_amount(F.col("l_quantity"), F.lit(2)).alias("amount"))


def j06(spark, d):
    checks = {"no priority": F.col("o_orderpriority").isNotNull(), "open": F.col("o_orderstatus") != "O", "low total": F.col("o_totalprice") > 1000}
    return report.validated(_t(spark, d, "orders"), checks).select("o_orderkey", "comments", "is_valid")


def j07(spark, d):
    return report.report_lines(_t(spark, d, "orders"), "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"])


QUERIES = {"j02_enriched": j02, "j03_class_amount": j03, "j06_validated": j06, "j07_report_lines": j07}
ORACLE = {
    "j02_enriched": "SELECT o_orderkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'AUTOMOBILE' THEN 'A' WHEN 'MACHINERY' THEN 'M' ELSE 'X' END AS market, coalesce(nullif(trim(c_name), ''), concat('CUST_', o_custkey)) AS client, coalesce(n_name, 'UNKNOWN') AS country FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "j03_class_amount": "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 WHEN l_returnflag = 'R' THEN 2 WHEN l_linestatus = 'F' THEN 3 ELSE 4 END AS class, lpad(CAST(CAST(floor(l_quantity * 2 * 100 + 0.5) AS BIGINT) AS VARCHAR), 16, '0') AS amount FROM lineitem",
    "j06_validated": "SELECT o_orderkey, c AS comments, CASE WHEN c = '' THEN 'Y' ELSE 'N' END AS is_valid FROM (SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderpriority IS NULL THEN 'no priority' END, CASE WHEN o_orderstatus = 'O' OR o_orderstatus IS NULL THEN 'open' END, CASE WHEN NOT coalesce(o_totalprice > 1000, false) THEN 'low total' END) AS c FROM orders)",
    "j07_report_lines": "SELECT o_orderkey, 'o_custkey' AS code, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders",
}
