"""The extracts' special tabs joined to their ports: groups, expressions, conditions, sources, columns, full extensions (family D).

Instances are picked by the names of their types, so that types of one name under several codes, and unions among custom ones, all count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions import decode, sqltext

from . import blocks
from .blocks import KEYS

#: Type names, upper case, as SQL patterns (fixed values).
TYPES = {
    "lookup": ("LOOKUP%",), "joiner": ("JOINER",), "source_qualifier": ("SOURCE QUALIFIER",), "sequence": ("SEQUENCE%",), "normalizer": ("NORMALIZER",), "router": ("ROUTER",), "aggregator": ("AGGREGATOR",), "custom": ("%CUSTOM%", "%UNION%"),
    "stored_procedure": ("%STORED%PROC%",), "transaction_control": ("%TRANSACTION%CONTROL%",),
}
WIDGET = ["widget_id", "version_number"]


def of_type(name: str) -> Column:
    own = F.upper(F.trim("widget_type_name"))
    out = F.lit(False)
    for pattern in TYPES[name]:
        out = out | own.like(pattern)
    return out


def full_extensions(rel: DataFrame, ext: DataFrame) -> DataFrame:
    """Every column of the metadata extensions."""
    named = F.col("metadata_extn_name").isNotNull()
    e = ext.select(
        "subject_id", F.col("metadata_extn_object_id").alias("widget_id"), "version_number", F.col("metadata_extn_name").alias("extension_name"), F.expr(decode.extension_type("metadata_extn_data_type")).alias("extension_datatype"),
        F.when(named, F.length("metadata_extn_value")).cast("long").alias("extension_prec"), F.col("metadata_extn_value").alias("extension_value"), F.when(named, F.when(F.col("domain_id").isNotNull() | F.col("domain_name").isNotNull(), "YES").otherwise("NO")).alias("reusable"),
        F.col("permissions").alias("extension_permissions"), F.col("line_no").cast("long").alias("extension_line_no"), F.col("domain_name").alias("extension_domain_name"), F.col("domain_usage").alias("extension_domain_usage"), F.col("metadata_extn_description").alias("extension_description"),
    )
    return e.join(rel.select("subject_id", *WIDGET).distinct(), ["subject_id", *WIDGET], "left_semi").distinct()


def port_texts(rel: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    """(widget_id, version_number, field_id, expression): each port's expression, its lines in order as one text."""
    link = repo["opb_widget_expr"].select(*WIDGET, F.col("output_field_id").alias("field_id"), "expr_id").join(rel.select(*WIDGET).distinct(), WIDGET, "left_semi")
    lines = link.join(repo["opb_expression"].select(*WIDGET, "expr_id", "line_no", "expression"), [*WIDGET, "expr_id"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "expr_id", "expression"))), lambda s: s["expression"]), " ")
    return lines.groupBy(*WIDGET, "field_id").agg(text.alias("expression"))


def router_groups(groups: DataFrame) -> DataFrame:
    """(widget_id, version_number, group_id, group_name, group_filter_condition) of routers."""
    pick = lambda a: F.max(F.when(F.col("attr_id") == a, F.nullif(F.trim("attr_value"), F.lit(""))))
    rows = groups.where("object_type = 15 and attr_id in (1, 3)")
    return rows.groupBy(F.col("object_id").alias("widget_id"), "version_number", "group_id").agg(pick(1).alias("group_name"), pick(3).alias("group_filter_condition"))


def group_keys(links: DataFrame) -> DataFrame:
    """Ports that an aggregator groups by."""
    return links.where("expr_type = 46").select(*WIDGET, F.col("output_field_id").alias("field_id")).distinct().withColumn("group_by", F.lit("YES"))


def associated_sources(rel: DataFrame, conn: DataFrame) -> DataFrame:
    """The objects that feed an instance, as one list."""
    keys = ["subject_id", "mapping_id", "instance_id"]
    rows = blocks.incoming(rel, conn).select(*keys, "object_name").distinct()
    return rows.groupBy(*keys).agg(F.expr("listagg(object_name, ', ') WITHIN GROUP (ORDER BY object_name)").alias("associated_source_definitions"))


def normalizer_columns(ports: DataFrame) -> DataFrame:
    """Ports (KEYS, field_order, field_name, wgt_*) with their column, category, and the column's occurrences, types and place."""
    name = F.col("field_name")
    occurs = name.rlike("(?i)_in[0-9]*$")
    kind = F.when(occurs, "INPUT_OCCURRENCE").when(F.upper(name).like("GK_%"), "GENERATED_KEY").when(F.upper(name).like("GCID_%"), "GENERATED_COLUMN_ID").otherwise("OUTPUT")
    rows = ports.withColumns({"normalizer_column_name": F.regexp_replace(name, "(?i)_in[0-9]*$", ""), "normalizer_port_category": kind})
    inputs, outputs = F.col("normalizer_port_category") == "INPUT_OCCURRENCE", F.col("normalizer_port_category") == "OUTPUT"
    n, of_output = F.count_if(inputs), lambda c: F.max(F.when(outputs, F.col(c)))
    columns = rows.where(inputs | outputs).groupBy(*KEYS, "normalizer_column_name").agg(
        F.when(n > 1, n).otherwise(0).alias("normalizer_occurs"), of_output("wgt_datatype").alias("normalizer_datatype_code"), of_output("wgt_prec").alias("normalizer_prec"), of_output("wgt_scale").alias("normalizer_scale"), F.min(F.when(inputs, F.col("field_order"))).alias("normalizer_column_order")
    )
    return rows.join(columns, [*KEYS, "normalizer_column_name"], "left")


def _lookup(out: DataFrame, rel: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    """Expression lines of each port, and the parts of the condition whose right side names it."""
    lines = blocks.port_expressions(rel, repo["opb_widget_field"], repo["opb_widget_expr"], repo["opb_expression"]).select(*WIDGET, "field_id", "expression_line_no", F.col("expression").alias("associated_expression"))
    rows = blocks.attr_rows(rel, repo["rep_widget_attr"]).where("attr_name = 'LOOKUP CONDITION' and attr_value is not null")
    whole = rows.groupBy(*KEYS).agg(F.max("attr_value").alias("condition"))
    parts = whole.select(*KEYS, F.posexplode(sqltext.condition_rows(F.col("condition"))).alias("at", "part"))
    left, op, right = sqltext.condition_parts(F.col("part"))
    parts = parts.select(*KEYS, (F.col("at") + 1).alias("condition_order"), left.alias("lookup_table_column"), op.alias("operator"), right.alias("transformation_port"), F.upper(F.trim(right)).alias("__port"))
    return out.join(lines, [*WIDGET, "field_id"], "left").withColumn("__port", F.upper(F.trim("field_name"))).join(parts, [*KEYS, "__port"], "left")


def _joiner(out: DataFrame, rel: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    """Whether a port is the master's, and the condition's sides."""
    rows = blocks.attr_rows(rel, repo["rep_widget_attr"]).where("attr_name = 'JOIN CONDITION' and attr_value is not null")
    whole = rows.groupBy(*KEYS).agg(F.max("attr_value").alias("join_condition"))
    left, op, right = sqltext.condition_parts(F.col("join_condition"))
    whole = whole.select(*KEYS, "join_condition", left.alias("condition_master"), op.alias("condition_operator"), right.alias("condition_detail"))
    return out.join(whole, KEYS, "left").withColumn("port_m", F.when(F.col("porttype").bitwiseAND(4) == 4, "YES").otherwise("NO"))


def _qualifier(out: DataFrame, rel: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    """The query by its names or by attribute 1, and the sources that feed the qualifier."""
    rows = blocks.attr_rows(rel, repo["rep_widget_attr"])
    query = rows.where((F.col("attr_name").isin("SQL QUERY", "SQL OVERRIDE", "SQL QUERY OVERRIDE")) | (F.col("attr_id") == 1)).groupBy(*KEYS).agg(F.max("attr_value").alias("sql_query"))
    return out.join(query, KEYS, "left").join(associated_sources(rel, repo["rep_mapping_conn_ports"]), ["subject_id", "mapping_id", "instance_id"], "left")


def _router(out: DataFrame, rel: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    """A row for each port and group."""
    return out.join(router_groups(repo["opb_table_group"]), WIDGET, "left")


def _aggregator(out: DataFrame, rel: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    """Each port's expression, and whether it is grouped by."""
    keyed = out.join(port_texts(rel, repo), [*WIDGET, "field_id"], "left").join(group_keys(repo["opb_widget_expr"]), [*WIDGET, "field_id"], "left")
    return keyed.withColumn("group_by", F.coalesce("group_by", F.lit("NO")))


def _custom(out: DataFrame, rel: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    """The input group of each connected port, numbered by the object that feeds it."""
    from pyspark.sql import Window

    keys = ["subject_id", "mapping_id", "instance_id"]
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy("object_name"))
    fed = blocks.incoming(rel, repo["rep_mapping_conn_ports"]).select(*keys, "field_name", F.col("object_name").alias("group_object"), place.alias("group_no"))
    return out.join(fed.distinct(), [*keys, "field_name"], "left")


def _procedure(out: DataFrame, rel: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    """A row for each port and property."""
    rows = blocks.attr_rows(rel, repo["rep_widget_attr"]).where("attr_name <> 'TRACING LEVEL'")
    return out.join(rows.select(*KEYS, F.col("attr_name").alias("property"), F.col("attr_value").alias("value")).distinct(), KEYS, "left")


def _plain(out: DataFrame, rel: DataFrame, repo: dict[str, DataFrame]) -> DataFrame:
    return out


#: By type: how its tab is joined, and its columns.
TABS: dict[str, tuple[Callable[[DataFrame, DataFrame, dict], DataFrame], tuple[str, ...]]] = {
    "lookup": (_lookup, ("expression_line_no", "associated_expression", "condition_order", "lookup_table_column", "operator", "transformation_port")),
    "joiner": (_joiner, ("port_m", "join_condition", "condition_master", "condition_operator", "condition_detail")),
    "source_qualifier": (_qualifier, ("sql_query", "associated_source_definitions")),
    "sequence": (_plain, ()),
    "normalizer": (lambda out, rel, repo: normalizer_columns(out), ("normalizer_column_name", "normalizer_port_category", "normalizer_occurs", "normalizer_datatype_code", "normalizer_prec", "normalizer_scale", "normalizer_column_order")),
    "router": (_router, ("group_id", "group_name", "group_filter_condition")),
    "aggregator": (_aggregator, ("expression", "group_by")),
    "custom": (_custom, ("group_object", "group_no")),
    "stored_procedure": (_procedure, ("property", "value")),
    "transaction_control": (_plain, ()),
}
SHOWN = ["workflow_name", "session_name", "mapping_name", "transformation_name", "transformation_type"]
EXTENSION = ["extension_name", "extension_datatype", "extension_prec", "extension_value", "reusable", "extension_permissions", "extension_line_no", "extension_domain_name", "extension_domain_usage", "extension_description"]


def special_extract(repo: dict[str, DataFrame], all_details: DataFrame, name: str) -> DataFrame:
    """The ports of a type's instances with the columns of its own tab, all extension columns and both neighbours."""
    join, columns = TABS[name]
    inst = blocks.instances(all_details, of_type(name))
    rel = blocks.relevant(inst)
    fields = repo["opb_widget_field"].select(*WIDGET, "field_id", "field_order", "field_name", "porttype", "wgt_datatype", "wgt_prec", "wgt_scale")
    ports = join(rel.join(fields, WIDGET), rel, repo)
    conn = repo["rep_mapping_conn_ports"]
    joined = blocks.port_connections(blocks.incoming(rel, conn), blocks.outgoing(rel, conn))
    ports = ports.join(joined, ["subject_id", "mapping_id", "instance_id", "field_name"], "left").join(full_extensions(rel, repo["rep_metadata_extns"]), ["subject_id", *WIDGET], "left")
    out = inst.select(*SHOWN, *KEYS).join(ports, KEYS)
    return out.select(*SHOWN, F.col("field_order").alias("port_order"), F.col("field_name").alias("port_name"), *columns, *EXTENSION, "previous_transformation", "next_transformation").distinct()
