"""Conditions, reference tables and summaries attached to lineage (families G, H, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions import sqltext

from . import graph

#: (widget type, attribute, bucket): where a type keeps a condition (fixed values of the ETL repository).
RULES = [
    (12, "JOIN CONDITION", "join"), (13, "FILTER CONDITION", "filter"), (3, "SOURCE FILTER", "filter"), (3, "USER DEFINED JOIN", "join"), (3, "SQL QUERY", "additional"), (16, "UPDATE STRATEGY EXPRESSION", "additional"),
    (11, "LOOKUP CONDITION", "join"), (11, "LOOKUP SOURCE FILTER", "filter"), (98, "TRANSACTION CONTROL CONDITION", "additional"),
]
#: Types whose condition decides whether a row goes on.
ELIGIBLE = (3, 11, 12, 13, 15, 16, 98)


def conditions(rows: DataFrame, types: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per condition: mapping, instance, bucket, source of the text, compacted text.

    rows are scoped attributes; the rule table is a fixed list, so it is a filter and a CASE, not a join.
    Router groups add theirs; the WHERE part of an SQL query counts as a filter.
    """
    bucket = None
    for code, name, kind in RULES:
        test = (F.col("widget_type") == code) & (F.col("attr_name") == name)
        bucket = F.when(test, kind) if bucket is None else bucket.when(test, kind)
    is_sql = F.col("attr_name") == "SQL QUERY"
    text = F.when(is_sql, sqltext.where_clause(F.col("attr_value"))).otherwise(F.col("attr_value"))
    plain = rows.withColumns({"bucket": F.when(is_sql, "filter").otherwise(bucket), "text": sqltext.compact(text)}).where("bucket is not null and text is not null")
    plain = plain.select("mapping_id", "instance_id", "widget_type", "bucket", F.col("attr_name").alias("label"), "text")
    routed = types.where("widget_type = 15").join(groups.where("group_condition is not null"), F.col("widget_id") == F.col("object_id"))
    routed = routed.select("mapping_id", "instance_id", "widget_type", F.lit("filter").alias("bucket"), F.concat(F.lit("GROUP "), "group_name").alias("label"), sqltext.compact(F.col("group_condition")).alias("text"))
    return plain.unionByName(routed).distinct()


def zero_rule_mappings(mappings: DataFrame, found: DataFrame) -> DataFrame:
    """Mappings without an eligibility condition."""
    return mappings.join(found.where(F.col("widget_type").isin(*ELIGIBLE)).select("mapping_id").distinct(), "mapping_id", "left_anti")


def referential(rows: DataFrame) -> DataFrame:
    """A lookup's reference table (its own, else the first of its override) and the fields of its condition."""
    pick = lambda n: F.max(F.when(F.col("attr_name") == n, F.col("attr_value")))
    wide = rows.where(F.col("attr_name").isin("LOOKUP TABLE NAME", "LOOKUP SQL OVERRIDE", "LOOKUP CONDITION")).groupBy("mapping_id", "instance_id").agg(pick("LOOKUP TABLE NAME").alias("own"), pick("LOOKUP SQL OVERRIDE").alias("override"), pick("LOOKUP CONDITION").alias("condition"))
    first = F.get(sqltext.sql_tables(F.col("override")), F.lit(0))
    return wide.select("mapping_id", "instance_id", F.coalesce("own", first).alias("table_name"), F.array_join(F.array_sort(sqltext.field_tokens(F.coalesce("condition", F.lit("")))), ",").alias("fields"))


def lookups_reaching(conn: DataFrame, inst: DataFrame) -> DataFrame:
    """lookups that an instance has upstream, by one closure over all mappings."""
    edges = conn.select("mapping_id", F.col("from_object_instance_id").alias("src"), F.col("to_object_instance_id").alias("dst")).distinct()
    starts = inst.where("widget_type = 11").select("mapping_id", F.col("instance_id").alias("start"))
    return graph.closure(starts, edges, ["mapping_id"]).where("depth > 0").select("mapping_id", F.col("start").alias("lookup"), F.col("node").alias("instance_id"))


def suppressed(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A cell is blank where it equals the one above, in the given order within the first column."""
    w = Window.partitionBy(columns[0]).orderBy(*order)
    return rows.withColumns({f"shown_{c}": F.when(F.lag(c).over(w).eqNullSafe(F.col(c)), "").otherwise(F.col(c).cast("string")) for c in columns[1:]})


def target_v2(inst: DataFrame, conn: DataFrame, fields: DataFrame) -> DataFrame:
    """Ports of a target as its upstream sees them, numbered, with their feeders listed."""
    own = inst.where("widget_type = 2").select("mapping_id", F.col("instance_id").alias("to_object_instance_id"))
    fed = conn.join(own, ["mapping_id", "to_object_instance_id"])
    known = fields.select(F.col("widget_id").alias("from_object_instance_id"), F.col("field_name").alias("from_object_field_name"), "wgt_datatype", "wgt_prec")
    fed = fed.join(known, ["from_object_instance_id", "from_object_field_name"], "left")
    out = fed.groupBy("mapping_id", F.col("to_object_instance_id").alias("instance_id"), F.col("to_object_field_name").alias("port_name")).agg(
        F.max("wgt_datatype").alias("datatype_code"), F.max("wgt_prec").alias("prec"), F.expr("listagg(DISTINCT concat(from_object_name, '.', from_object_field_name), ', ') WITHIN GROUP (ORDER BY concat(from_object_name, '.', from_object_field_name))").alias("feeders")
    )
    return out.withColumn("port_order", F.row_number().over(Window.partitionBy("mapping_id", "instance_id").orderBy("port_name")))


def lineage_detail(records: DataFrame) -> DataFrame:
    """Records numbered within their mapping, with texts for what is missing."""
    n = F.row_number().over(Window.partitionBy("mapping_id").orderBy("start"))
    return records.select("mapping_id", n.alias("row_no"), "start", F.when(F.col("sources") == "", "Not found").otherwise(F.col("sources")).alias("sources"), F.coalesce("primary_rule", F.lit("Direct move")).alias("rule"))


def lineage_summary(records: DataFrame) -> DataFrame:
    """Totals over all records."""
    return records.agg(F.count("*").alias("records"), F.countDistinct("mapping_id").alias("mappings"), F.count("primary_rule").alias("with_rule"), F.sum("n_lookups").alias("lookups"), F.sum("n_visited").alias("visited"))
