"""Detail extracts of the transformation types (family D): shared blocks driven by one specification each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.functions import decode
from metaloom.sources.store import cut

from . import blocks
from .blocks import KEYS, SCOPE

WIDGET = ["widget_id", "version_number"]
#: The type whose ports have a row for each line of their expression.
LINED = 5


@dataclass(frozen=True)
class Spec:
    """pivot: property to attribute names; shown: output column to SQL over the properties."""

    code: int
    pivot: dict[str, tuple[str, ...]]
    shown: dict[str, str]
    port_bits: str = "iov"
    equal_flags: bool = False
    datatype_names: bool = True
    more: dict[str, str] = field(default_factory=dict)


def _plain(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_t = {"tracing_level": decode.tracing("tracing_level_code")}
_tp = {"tracing_level_code": ("TRACING LEVEL",)}

#: Attribute names and defaults are those of the ETL repository (fixed values).
SPECS: dict[str, Spec] = {
    "d01_expression": Spec(5, _tp, {"tracing_level": decode.tracing("tracing_level_code", "expression")}, equal_flags=True, datatype_names=False),
    "d02_lookup": Spec(11, {
        "lookup_sql_override": ("LOOKUP SQL OVERRIDE",), "lookup_table_name": ("LOOKUP TABLE NAME", "LOOKUP SOURCE NAME"), "lookup_source_filter": ("LOOKUP SOURCE FILTER",),
        "lookup_caching_enabled": ("LOOKUP CACHING ENABLED", "LOOKUP CACHE ENABLED"), "lookup_policy_on_multiple_match": ("LOOKUP POLICY ON MULTIPLE MATCH",), "lookup_condition": ("LOOKUP CONDITION",),
        "connection_information": ("CONNECTION INFORMATION",), "source_type": ("SOURCE TYPE",), **_tp, "lookup_cache_directory_name": ("LOOKUP CACHE DIRECTORY NAME",), "lookup_cache_persistent": ("LOOKUP CACHE PERSISTENT",),
        "lookup_data_cache_size": ("LOOKUP DATA CACHE SIZE",), "lookup_index_cache_size": ("LOOKUP INDEX CACHE SIZE",), "dynamic_lookup_cache": ("DYNAMIC LOOKUP CACHE",), "synchronize_dynamic_cache": ("SYNCHRONIZE DYNAMIC CACHE",),
        "output_old_value_on_update": ("OUTPUT OLD VALUE ON UPDATE",), "update_dynamic_cache_condition": ("UPDATE DYNAMIC CACHE CONDITION",), "cache_file_name_prefix": ("CACHE FILE NAME PREFIX",), "recache_from_lookup_source": ("RE-CACHE FROM LOOKUP SOURCE",),
        "insert_else_update": ("INSERT ELSE UPDATE",), "update_else_insert": ("UPDATE ELSE INSERT",), "datetime_format": ("DATETIME FORMAT",), "thousand_separator": ("THOUSAND SEPARATOR",), "decimal_separator": ("DECIMAL SEPARATOR",),
        "case_sensitive_string_comparison": ("CASE SENSITIVE STRING COMPARISON",), "null_ordering": ("NULL ORDERING",), "sorted_input": ("SORTED INPUT",), "lookup_source_is_static": ("LOOKUP SOURCE IS STATIC",), "pre_build_lookup_cache": ("PRE-BUILD LOOKUP CACHE",), "subsecond_precision": ("SUBSECOND PRECISION",),
    }, {
        **_plain("lookup_sql_override", "lookup_table_name", "lookup_source_filter", "lookup_policy_on_multiple_match", "lookup_condition", "connection_information", "source_type", "lookup_cache_directory_name", "lookup_data_cache_size", "lookup_index_cache_size",
                 "update_dynamic_cache_condition", "cache_file_name_prefix", "datetime_format", "thousand_separator", "decimal_separator", "null_ordering", "subsecond_precision", "pre_build_lookup_cache"),
        **{c: decode.yes_no(c, "lookup") for c in ("lookup_caching_enabled", "lookup_cache_persistent", "dynamic_lookup_cache", "synchronize_dynamic_cache", "output_old_value_on_update", "recache_from_lookup_source", "insert_else_update", "update_else_insert", "case_sensitive_string_comparison", "sorted_input", "lookup_source_is_static")},
        "tracing_level": decode.tracing("tracing_level_code", "lookup"),
    }, "iolr"),
    "d04_joiner": Spec(12, {
        "cache_directory": ("CACHE DIRECTORY",), "join_condition": ("JOIN CONDITION",), "join_type_code": ("JOIN TYPE",), "null_master_code": ("NULL ORDERING IN MASTER", "NULL ORDER IN MASTER"), "null_detail_code": ("NULL ORDERING IN DETAIL", "NULL ORDER IN DETAIL"),
        **_tp, "data_cache_size": ("JOINER DATA CACHE SIZE", "DATA CACHE SIZE"), "index_cache_size": ("JOINER INDEX CACHE SIZE", "INDEX CACHE SIZE"), "sorted_input_code": ("SORTED INPUT",), "master_sort_order": ("MASTER SORT ORDER",), "scope_code": ("TRANSFORMATION SCOPE",),
    }, {
        **_plain("cache_directory", "join_condition", "master_sort_order"), "join_type": decode.join_type("join_type_code"), "null_ordering_in_master": decode.null_order("null_master_code"), "null_ordering_in_detail": decode.null_order("null_detail_code"),
        "tracing_level": decode.tracing("tracing_level_code", "joiner"), "joiner_data_cache_size": "coalesce(data_cache_size, 'Auto')", "joiner_index_cache_size": "coalesce(index_cache_size, 'Auto')", "sorted_input": decode.yes_no("sorted_input_code", "joiner"), "transformation_scope": decode.scope("scope_code"),
    }, "iol"),
    "d05_source_qualifier": Spec(3, {
        "sql_query": ("SQL QUERY", "SQL OVERRIDE", "SQL QUERY OVERRIDE"), "user_defined_join": ("USER DEFINED JOIN", "USER-DEFINED JOIN"), "source_filter": ("SOURCE FILTER",), "number_of_sorted_ports": ("NUMBER OF SORTED PORTS", "NUMBER OF SORTED COLUMNS"), **_tp,
        "select_distinct_code": ("SELECT DISTINCT", "SELECT DISTINCT OPTION"), "pre_sql": ("PRE SQL",), "post_sql": ("POST SQL",), "deterministic_code": ("OUTPUT IS DETERMINISTIC", "OUTPUT IS DETERMINISTIC."), "repeatable_code": ("OUTPUT IS REPEATABLE", "OUTPUT IS REPEATABLE."),
    }, {**_plain("sql_query", "user_defined_join", "source_filter", "pre_sql", "post_sql"), "number_of_sorted_ports": "coalesce(number_of_sorted_ports, '0')", **_t, "select_distinct": decode.yes_no("select_distinct_code"), "output_is_deterministic": decode.yes_no("deterministic_code"), "output_is_repeatable": decode.yes_no("repeatable_code")}),
    "d06_sorter": Spec(80, {
        "sorter_cache_size": ("SORTER CACHE SIZE", "SORTER DATA CACHE SIZE", "CACHE SIZE"), "case_sensitive_code": ("CASE SENSITIVE", "CASE-SENSITIVE"), "work_directory": ("WORK DIRECTORY", "WORKING DIRECTORY"), "distinct_code": ("DISTINCT", "DISTINCT OUTPUT ROWS"), **_tp, "null_low_code": ("NULL TREATED LOW", "NULL TREATED AS LOW"), "scope_code": ("TRANSFORMATION SCOPE",),
    }, {"sorter_cache_size": "coalesce(sorter_cache_size, 'Auto')", "case_sensitive": decode.yes_no("case_sensitive_code"), **_plain("work_directory"), "distinct_rows": decode.yes_no("distinct_code"), **_t, "null_treated_low": decode.yes_no("null_low_code"), "transformation_scope": decode.scope("scope_code")},
        more={"sort_key": "CASE WHEN property IN (1, 2) THEN 'YES' ELSE 'NO' END", "sort_direction": "CASE property WHEN 1 THEN 'Ascending' WHEN 2 THEN 'Descending' END"}),
    "d07_source_definition": Spec(1, {"owner_name": ("OWNER NAME", "OWNER"), "source_table_name": ("SOURCE TABLE NAME", "TABLE NAME", "SOURCE NAME"), "source_timestamp": ("SOURCE TIMESTAMP", "SOURCE TIME STAMP", "SOURCE TIME")},
                                  {**_plain("owner_name", "source_timestamp"), "source_table_name": "coalesce(source_table_name, transformation_name)"}),
    "d08_target_definition": Spec(2, {
        "reject_code": ("REJECT TRUNCATED/OVERFLOWED ROWS", "REJECT TRUNCATED OR OVERFLOWED ROWS", "REJECT TRUNCATED/OVERFLOW ROWS", "REJECT OVERFLOWED ROWS"), "update_override": ("UPDATE OVERRIDE", "UPDATE OVERRIDE SQL"), "table_name_prefix": ("TABLE NAME PREFIX", "TARGET TABLE NAME PREFIX"), "pre_sql": ("PRE SQL", "PRE-SQL"), "post_sql": ("POST SQL", "POST-SQL"), "target_table_name": ("TARGET TABLE NAME", "TABLE NAME", "TARGET NAME"),
    }, {"reject_truncated_rows": decode.yes_no("reject_code"), **_plain("update_override", "table_name_prefix", "pre_sql", "post_sql"), "target_table_name": "coalesce(target_table_name, transformation_name)"}),
    "d09_sequence": Spec(7, {
        "start_value": ("START VALUE", "STARTVALUE"), "increment_by": ("INCREMENT BY", "INCREMENTBY", "INCREMENT"), "end_value": ("END VALUE", "ENDVALUE", "MAXIMUM VALUE"), "current_value": ("CURRENT VALUE", "CURRENTVALUE"), "cycle_code": ("CYCLE", "CYCLE OPTION"), "cached_values": ("NUMBER OF CACHED VALUES", "NUMBER OF CACHE VALUES", "CACHE SIZE"), "reset_code": ("RESET", "RESET SEQUENCE"), **_tp,
    }, {"start_value": "coalesce(start_value, '0')", "increment_by": "coalesce(increment_by, '1')", "end_value": "coalesce(end_value, '9223372036854775807')", "current_value": "coalesce(current_value, '1')", "cycle": decode.yes_no("cycle_code"), "number_of_cached_values": "coalesce(cached_values, '0')", "reset": decode.yes_no("reset_code"), **_t}),
    "d10_filter": Spec(13, {"filter_condition": ("FILTER CONDITION", "FILTERCONDITION", "FILTER CONDITION EXPRESSION"), **_tp}, {**_plain("filter_condition"), **_t}),
    "d11_normalizer": Spec(14, {"reset_code": ("RESET", "RESET SEQUENCE"), "restart_code": ("RESTART", "RESTART SEQUENCE"), **_tp}, {"reset": decode.yes_no("reset_code"), "restart": decode.yes_no("restart_code"), **_t}),
    "d12_router": Spec(15, _tp, _t),
    "d13_aggregator": Spec(9, {
        "cache_directory": ("CACHE DIRECTORY", "CACHE DIR"), **_tp, "sorted_input_code": ("SORTED INPUT", "SORTED INPUT OPTION"), "data_cache_size": ("AGGREGATOR DATA CACHE SIZE", "DATA CACHE SIZE"), "index_cache_size": ("AGGREGATOR INDEX CACHE SIZE", "INDEX CACHE SIZE"), "scope_code": ("TRANSFORMATION SCOPE",),
    }, {"cache_directory": "coalesce(cache_directory, '$PMCacheDir')", **_t, "sorted_input": decode.yes_no("sorted_input_code"), "aggregator_data_cache_size": "coalesce(data_cache_size, 'Auto')", "aggregator_index_cache_size": "coalesce(index_cache_size, 'Auto')", "transformation_scope": decode.scope("scope_code"), "group_by": "CAST(NULL AS VARCHAR(3))"}),
    "d14_update_strategy": Spec(16, {"update_strategy_expression": ("UPDATE STRATEGY EXPRESSION", "UPDATE STRATEGY", "UPDATE EXPRESSION"), "forward_code": ("FORWARD REJECTED ROWS", "FORWARD REJECTED ROW"), **_tp}, {**_plain("update_strategy_expression"), "forward_rejected_rows": decode.yes_no("forward_code"), **_t}),
    "d15_custom": Spec(97, {
        "language": ("LANGUAGE",), "module_identifier": ("MODULE IDENTIFIER", "MODULE ID"), "function_identifier": ("FUNCTION IDENTIFIER", "FUNCTION ID"), "runtime_location": ("RUNTIME LOCATION",), **_tp, "partitionable_code": ("IS PARTITIONABLE", "PARTITIONABLE"), "block_code": ("INPUTS MUST BLOCK", "INPUT MUST BLOCK"), "active_code": ("IS ACTIVE", "ACTIVE"),
        "update_code": ("UPDATE STRATEGY TRANSFORMATION", "IS UPDATE STRATEGY TRANSFORMATION"), "scope_code": ("TRANSFORMATION SCOPE",), "generate_code": ("GENERATE TRANSACTION", "GENERATES TRANSACTION"), "repeatable_code": ("OUTPUT IS REPEATABLE", "OUTPUT IS REPEATABLE."), "single_code": ("REQUIRES SINGLE THREAD PER PARTITION", "REQUIRE SINGLE THREAD PER PARTITION"), "deterministic_code": ("OUTPUT IS DETERMINISTIC", "OUTPUT IS DETERMINISTIC."),
    }, {**_plain("language", "module_identifier", "function_identifier", "runtime_location"), **_t, "is_partitionable": decode.yes_no("partitionable_code"), "inputs_must_block": decode.yes_no("block_code"), "is_active": decode.yes_no("active_code"), "update_strategy_transformation": decode.yes_no("update_code"), "transformation_scope": decode.scope("scope_code"),
        "generate_transaction": decode.yes_no("generate_code"), "output_is_repeatable": decode.yes_no("repeatable_code"), "requires_single_thread": decode.yes_no("single_code"), "output_is_deterministic": decode.yes_no("deterministic_code")}),
    "d17_transaction_control": Spec(98, {"transaction_control_condition": ("TRANSACTION CONTROL CONDITION", "TRANSACTION CONTROL EXPRESSION", "TRANSACTION CONDITION"), **_tp}, {**_plain("transaction_control_condition"), **_t}),
}


def parts(repo: dict[str, DataFrame], details: DataFrame) -> dict[str, DataFrame]:
    """What extracts assemble, for instances of any types, each part with their keys and type: attributes that apply (attrs), ports with their neighbours (ports), expression lines (lines), extensions (exts)."""
    rel = blocks.relevant(details)
    joined = blocks.port_connections(blocks.incoming(rel, repo["rep_mapping_conn_ports"]), blocks.outgoing(rel, repo["rep_mapping_conn_ports"]))
    ports = rel.join(repo["opb_widget_field"], WIDGET).join(joined, ["subject_id", "mapping_id", "instance_id", "field_name"], "left")
    lined = blocks.relevant(details.where(F.col("widget_type") == LINED))
    lines = blocks.port_expressions(lined, repo["opb_widget_field"], repo["opb_widget_expr"], repo["opb_expression"]).select(*WIDGET, "field_id", "expression_line_no", F.nullif("expression", F.lit("- N/A -")).alias("expression"), F.lit(LINED).alias("widget_type"))
    exts = rel.join(blocks.extensions(rel, repo["rep_metadata_extns"]), ["subject_id", *WIDGET])
    return {"attrs": blocks.attr_rows(rel, repo["rep_widget_attr"]), "ports": ports, "lines": lines, "exts": exts}


def assembled(inst: DataFrame, of: dict[str, DataFrame], spec: Spec) -> DataFrame:
    """One row per scope, instance, port, and expression line (Expression) or extension: properties, ports, neighbours. Instances and parts are of the type alone; all but the lines meet by the instance's keys, after one shuffle of each."""
    of = {name: part.drop("widget_type") for name, part in of.items()}
    out = inst.join(blocks.pivot_attrs(of["attrs"], spec.pivot), KEYS, "left").join(of["exts"], KEYS, "left").join(of["ports"], KEYS)
    if spec.code == LINED:
        out = out.join(of["lines"], [*WIDGET, "field_id"], "left")
    return out.select(*SCOPE, "transformation_name", "transformation_type", *[F.expr(f"{sql} AS {name}") for name, sql in _columns(spec).items()]).distinct()


def extract(repo: dict[str, DataFrame], details: DataFrame, spec: Spec) -> DataFrame:
    """One extract by itself."""
    own = details.where(F.col("widget_type") == spec.code)
    return assembled(blocks.instances(own, F.lit(True)), parts(repo, own), spec)


def extracts(repo: dict[str, DataFrame], details: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """Every registered extract. The wide tables are joined once for all types when the first is made, and written by type, so that each extract reads and shuffles its own rows only."""

    @cache
    def shared() -> tuple[DataFrame, dict[str, DataFrame]]:
        known = cut(details.where(F.col("widget_type").isin([spec.code for spec in SPECS.values()])), "details", "widget_type")
        return known, {name: cut(part, name, "widget_type") for name, part in parts(repo, known).items()}

    def make(spec: Spec) -> DataFrame:
        known, of = shared()
        own = F.col("widget_type") == spec.code
        return assembled(blocks.instances(known, own), {name: part.where(own) for name, part in of.items()}, spec)

    return {name: partial(make, spec) for name, spec in SPECS.items()}


def _columns(spec: Spec) -> dict[str, str]:
    flag = decode.port_flag_equal if spec.equal_flags else decode.port_flag
    cols = {"port_order": "field_order", "port_name": "field_name", "datatype": decode.datatype("wgt_datatype") if spec.datatype_names else "wgt_datatype", "prec": "wgt_prec", "scale": "wgt_scale"}
    cols |= {f"port_{b}": flag("porttype", b) for b in spec.port_bits} | spec.more | spec.shown
    cols |= {"expression_line_no": "expression_line_no", "expression": "expression"} if spec.code == 5 else {}
    return cols | {c: c for c in ("extension_name", "extension_datatype", "extension_prec", "extension_value", "reusable", "extension_line_no", "previous_transformation", "next_transformation")}
