"""Blocks that the detail extracts share (family C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions import decode

KEYS = ["subject_id", "mapping_id", "instance_id", "widget_id", "version_number"]
SCOPE = ["subject_area", "workflow_name", "session_instance_name", "session_name", "mapping_name"]


def instances(details: DataFrame, condition: Column) -> DataFrame:
    """Instances in scope of the types that the condition picks, with their scope columns."""
    return details.where(condition).withColumnsRenamed({"instance_name": "transformation_name", "widget_type_name": "transformation_type"})


def relevant(inst: DataFrame) -> DataFrame:
    """Distinct keys, to narrow wide tables before their joins."""
    return inst.select(*KEYS, "widget_type").distinct()


def attr_rows(rel: DataFrame, attrs: DataFrame) -> DataFrame:
    """Attributes that apply to an instance; a null or zero scope column means any.

    An equi-join on widget and version whose residual checks the scopes: no cross product.
    """
    a = attrs.select("widget_id", "version_number", F.col("mapping_id").alias("a_map"), F.col("instance_id").alias("a_inst"), F.col("widget_type").alias("a_type"), "attr_id", "line_no",
                     F.upper(F.trim("attr_name")).alias("attr_name"), F.expr(decode.present("attr_value")).alias("attr_value"))
    any_or = lambda own, theirs: F.coalesce(F.col(theirs), F.lit(0)).isin(0) | (F.col(theirs) == F.col(own))
    fits = any_or("instance_id", "a_inst") & any_or("mapping_id", "a_map") & (F.col("a_type").isNull() | (F.col("a_type") == F.col("widget_type")))
    return rel.join(a, ["widget_id", "version_number"]).where(fits).drop("a_map", "a_inst", "a_type")


def pivot_attrs(rows: DataFrame, spec: dict[str, tuple[str, ...]]) -> DataFrame:
    """One column per property, the largest value among its attribute names."""
    names = sorted({n for names in spec.values() for n in names})
    kept = rows.where(F.col("attr_name").isin(names))
    return kept.groupBy(*KEYS).agg(*[F.max(F.when(F.col("attr_name").isin(list(ns)), F.col("attr_value"))).alias(c) for c, ns in spec.items()])


def extensions(rel: DataFrame, ext: DataFrame) -> DataFrame:
    """Metadata extensions; precision is the value's length, reusable tells of a domain."""
    e = ext.select("subject_id", F.col("metadata_extn_object_id").alias("widget_id"), "version_number", F.col("metadata_extn_name").alias("extension_name"),
                   F.expr(decode.extension_type("metadata_extn_data_type")).alias("extension_datatype"), F.length("metadata_extn_value").cast("long").alias("extension_prec"), F.col("metadata_extn_value").alias("extension_value"),
                   F.when(F.col("domain_id").isNotNull(), "YES").otherwise("NO").alias("reusable"), F.col("line_no").cast("long").alias("extension_line_no"))
    return rel.select("subject_id", "widget_id", "version_number").distinct().join(e, ["subject_id", "widget_id", "version_number"])


def incoming(rel: DataFrame, conn: DataFrame) -> DataFrame:
    """What feeds each port of the instances, as object.field; distinct."""
    return _connections(rel, conn, "to", "from")


def outgoing(rel: DataFrame, conn: DataFrame) -> DataFrame:
    """What each port of the instances feeds."""
    return _connections(rel, conn, "from", "to")


def _connections(rel: DataFrame, conn: DataFrame, own: str, other: str) -> DataFrame:
    c = conn.select("subject_id", "mapping_id", F.col(f"{own}_object_instance_id").alias("instance_id"), F.col(f"{own}_object_field_name").alias("field_name"),
                    F.col(f"{other}_object_name").alias("object_name"), F.concat_ws(".", f"{other}_object_name", f"{other}_object_field_name").alias("connected"))
    keys = ["subject_id", "mapping_id", "instance_id"]
    return c.where("connected is not null").join(rel.select(*keys).distinct(), keys, "left_semi").distinct()


def port_connections(inc: DataFrame, out: DataFrame) -> DataFrame:
    """C14: both neighbour lists of every connected port; the union of keys, then one aggregation per side."""
    keys = ["subject_id", "mapping_id", "instance_id", "field_name"]
    listed = lambda df, name: df.groupBy(*keys).agg(F.expr("listagg(connected, ', ') WITHIN GROUP (ORDER BY connected)").alias(name))
    every = inc.select(*keys).union(out.select(*keys)).distinct()
    return every.join(listed(inc, "previous_transformation"), keys, "left").join(listed(out, "next_transformation"), keys, "left")


def port_connections_full(inc: DataFrame, out: DataFrame) -> DataFrame:
    """The same by a full outer join of the two aggregations."""
    keys = ["subject_id", "mapping_id", "instance_id", "field_name"]
    listed = lambda df, name: df.groupBy(*keys).agg(F.expr("listagg(connected, ', ') WITHIN GROUP (ORDER BY connected)").alias(name))
    return listed(inc, "previous_transformation").join(listed(out, "next_transformation"), keys, "full_outer")


def port_expressions(rel: DataFrame, fields: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """C20: each port's expression lines, '- N/A -' where it has none."""
    link = links.select("widget_id", "version_number", F.col("output_field_id").alias("field_id"), "expr_id", "expr_type")
    text = texts.select("widget_id", "version_number", "expr_id", F.col("line_no").cast("long").alias("expression_line_no"), "expression")
    ports = rel.select("widget_id", "version_number").distinct().join(fields, ["widget_id", "version_number"])
    out = ports.join(link, ["widget_id", "version_number", "field_id"], "left").join(text, ["widget_id", "version_number", "expr_id"], "left")
    return out.withColumn("expression", F.coalesce("expression", F.lit("- N/A -")))


def joined_expressions(texts: DataFrame, sep: str = " ") -> DataFrame:
    """The lines of an expression as one text, in line order."""
    return texts.groupBy("widget_id", "version_number", "expr_id").agg(F.expr(f"listagg(expression, '{sep}') WITHIN GROUP (ORDER BY line_no)").alias("expression"))


def long_text(rows: DataFrame, names: tuple[str, ...], sep: str, trim: bool) -> DataFrame:
    """A long value kept over several lines, assembled in line order."""
    kept = rows.where(F.col("attr_name").isin(list(names)) & F.col("attr_value").isNotNull())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "attr_id", "attr_value"))), lambda x: x["attr_value"]), sep)
    return kept.groupBy(*KEYS).agg((F.rtrim(text) if trim else text).alias("long_text"))
