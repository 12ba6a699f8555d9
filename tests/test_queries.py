"""Registered queries against their SQL; graph loops against small graphs made by hand."""

import textwrap

import pytest

from metaloom.functions import sqltext
from metaloom.operators import graph, inventory, lineage
from metaloom.plans.registry import ORACLE, QUERIES
from tests.compare import assert_same

SF = "sf0.001"
SOME = ["b02_all_details", "b06_missing_requested", "c03_attr_rows", "c05_decodes", "c14_port_connections", "d01_expression", "d02_lookup", "d04_joiner", "d10_filter", "d02b_condition_rows", "f09_trace_back", "f31_lineage_records", "f33_completeness", "f43_path_rows", "e03_transformation_order", "e08_session_order", "i01_paths_per_field", "g07_upstream_mapping", "f39_select_items", "f09_typed_trace", "f20_union_edges", "f28_select_targets", "f41_plain_rules", "e07_session_links", "g09_chain_edges", "g21_connector_conditions", "d02d_lookup_port_conditions", "f44_detail_match", "a12_json_records", "i04_expand_mapplets", "j05_sequence"]
SOME += ["e03_queue_order", "e07_walk_order", "e08_queue_order", "e11_session_order", "e12_session_ranks", "e22_table_flow", "f47_ranked_links", "g10_chain_text", "g14_chain_sources", "f31_record", "f33_completeness_report", "f26_diagnostic_rows", "f42_path_forecast", "f42_paths_by_target", "f39_items_and_aliases", "g22_where_of_blocks", "g23_tables_and_aliases", "g24_condition_fields", "d02_lookup_tab", "d05_qualifier_tab", "d12_router_tab", "d13_aggregator_tab", "a15_written_instances", "b10_instance_coverage"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    assert assert_same(QUERIES[name](spark, f"/root/testdata/{SF}"), ORACLE[name], SF) > 0


def test_closure_and_layers_on_cycles(spark):
    edges = spark.createDataFrame([(1, a, b) for a, b in ["ab", "bc", "cb", "ad", "de", "ce"]] + [(2, "a", "b")], "k int, src string, dst string")
    starts = spark.createDataFrame([(1, "a"), (2, "a")], "k int, start string")
    got = {(r["k"], r["node"]): r["depth"] for r in graph.closure(starts, edges, ["k"]).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "d"): 1, (1, "c"): 2, (1, "e"): 2, (2, "a"): 0, (2, "b"): 1}
    nodes = spark.createDataFrame([(1, n) for n in "abcde"] + [(2, n) for n in "ab"], "k int, node string")
    got = {(r["k"], r["node"]): r["layer"] for r in graph.layers(nodes, edges, ["k"]).collect()}
    assert got == {(1, "a"): 0, (1, "d"): 1, (1, "b"): None, (1, "c"): None, (1, "e"): None, (2, "a"): 0, (2, "b"): 1}


def test_forward_paths_are_simple(spark):
    edges = spark.createDataFrame([(1, a, b) for a, b in ["ab", "ba", "bc", "ac", "cd"]], "k int, src string, dst string")
    one = lambda n: spark.createDataFrame([(1, n)], "k int, node string")
    assert sorted("".join(r["path"]) for r in graph.forward_paths(edges, one("a"), one("d"), ["k"]).collect()) == ["abcd", "acd"]


def test_requested_names_and_gate(spark):
    names = inventory.requested_names(spark.createDataFrame([("A, b,a ,, C",)], "x string"), "x").orderBy("at")
    assert [r["name"] for r in names.collect()] == ["A", "b", "C"]
    report = spark.createDataFrame([(1, True), (2, False)], "mapping_id long, is_complete boolean")
    with pytest.raises(ValueError, match="mapping 2"):
        lineage.assert_complete(report)
    lineage.assert_complete(report.where("is_complete"))


def test_sql_text(spark):
    sql = "SELECT DISTINCT f(a, ',') AS x, t.b, c d, e -- note\nFROM own.t1@db t, s JOIN t2 ON t.k = t2.k WHERE a > 1 GROUP BY b"
    c = sqltext.F.lit(sql)
    row = spark.range(1).select(sqltext.select_items(c).alias("items"), sqltext.sql_tables(c).alias("tables"), sqltext.where_clause(c).alias("w"), sqltext.field_tokens(sqltext.F.lit("IIF(A > 'B c', X_1, null)")).alias("t"), sqltext.clean_text(sqltext.F.lit(" a \r\n\r\n b")).alias("clean")).first()
    assert row["items"] == ["f(a, ',') AS x", "t.b", "c d", "e"] and row["tables"] == ["T1", "T2"] and row["w"] == "a > 1" and row["t"] == ["A", "X_1"] and row["clean"] == "a\nb"
    aliases = spark.range(1).select(sqltext.F.transform(sqltext.select_items(c), sqltext.alias_of).alias("a")).first()["a"]
    assert aliases == ["x", "b", "d", "e"]


def test_plain_rules(spark):
    rules = {
        "": "No transformation logic provided", " AMT ": "Pass through AMT without change", "iif(A > 1, B, IIF(C, D, E))": "If A > 1 then B, otherwise IIF(C, D, E)", "DECODE(A, 1, 2)": "Map value using DECODE logic", "NVL2(A, B, C)": "Replace NULL values using NVL logic",
        "LTRIM( X )": "Trim whitespace from X", "Upper(X)": "Convert X to Upper case", "SUBSTR(X, 2, 3)": "Extract part of X starting at position 2", "TO_DATE(D, 'YYYY')": "Parse D as date using format 'YYYY'", "TO_CHAR(D)": "Convert D to text", "a||b": "Concatenate values", "A * 2": "Apply arithmetic calculation",
        ":LKP.T(A)": "Perform a lookup", "(NEXTVAL)": "Generate next sequence value", "trunc(SYSDATE)": "Use current system date/time", "F(A)": "Apply expression: F(A)", 
    }
    for long in ("F(" + "ab, " * 60 + ")", "G(" + "x" * 138, "F(" + "abc,  " * 23 + "x y)", "H(" + "x" * 300):
        rules[long] = "Apply expression: " + textwrap.shorten(long, 140, placeholder=" ...")
    rows = spark.createDataFrame([(k,) for k in rules], "e string").select("e", sqltext.plain_rule(sqltext.F.col("e")).alias("r")).collect()
    assert {r["e"]: r["r"] for r in rows} == rules
