"""The summary and the combined table cover every registered extract."""

from metaloom.operators import extract, inventory
from metaloom.plans import metadata
from metaloom.plans.registry import ORACLE, QUERIES
from tests.compare import assert_same, oracle

DATA, SF = "/root/testdata/sf0.001", "sf0.001"


def test_statuses(spark):
    df = spark.createDataFrame([("m",), ("m",), ("n",)], "mapping_name string")
    audit = spark.createDataFrame([(44, "Mapplet", 3, 2, "MISSING"), (13, "Filter", 1, 1, "PRESENT")], "widget_type int, widget_type_name string, instances long, mappings long, status string")
    got = inventory.run_summary(spark, {"good": lambda: df, "bad": lambda: df.selectExpr("mapping_name", "no_such_column"), "late": lambda: df.selectExpr("raise_error('x') AS mapping_name")}, audit, subject="S")
    assert "no_such_column" in got.where("query_name = 'bad'").first()["message"] and got.where("message is null").count() == 2
    assert {tuple(r) for r in got.drop("message").collect()} == {("good", "SUCCESS", 3, 2, "S", "ALL"), ("bad", "FAILED", None, None, "S", "ALL"), ("late", "FAILED", None, None, "S", "ALL"), ("Mapplet", "MISSING", 0, 2, "S", "ALL")}


def test_summary_covers_every_extract(spark):
    columns, rows = oracle(ORACLE["b11_run_summary"], SF)
    assert set(extract.SPECS) <= {r[columns.index("query_name")] for r in rows}
    assert assert_same(QUERIES["b11_run_summary"](spark, DATA), ORACLE["b11_run_summary"], SF) >= 16


def test_combined_table_holds_the_rows_of_every_extract(spark):
    assert assert_same(QUERIES["b12_combine_all"](spark, DATA), ORACLE["b12_combine_all"], SF) > 0


def test_extracts_read_their_own_rows_of_tables_joined_once(spark):
    makes = metadata._all(spark, DATA)[1]
    for name in ("d01_expression", "d10_filter"):
        plan = makes[name]()._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.splitlines() if "FileScan" in x]
        assert len(scans) == (5 if name == "d01_expression" else 4) and all("PartitionFilters: [isnotnull(widget_type" in x for x in scans), plan
