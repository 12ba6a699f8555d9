"""Summaries over traces and condition texts (families H and I)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.functions import sqltext

TEXT = ["mapping_id", "instance", "name"]


def expression_lineage(derivations: DataFrame) -> DataFrame:
    """Fields of condition attributes with their sources, each once."""
    return derivations.select("mapping_id", "instance", F.col("name").alias("attribute"), "field", "sources").distinct()


def lookup_rows(used: DataFrame) -> DataFrame:
    """Lookups of all traces, each once by mapping, instance and its four texts."""
    texts = ("lookup_table", "lookup_condition", "lookup_sql_override", "lookup_source_filter")
    return used.select("mapping_id", "instance", *[F.coalesce(c, F.lit("")).alias(c) for c in texts]).distinct()


def transformation_detail(trace: DataFrame, facts: DataFrame) -> DataFrame:
    """Ports of transformations that the traces of a mapping touch, each once, with the rule in plain words."""
    met = trace.select("mapping_id", "node").distinct().join(facts.where("type not in ('Source Definition', 'Target Definition')"), ["mapping_id", "node"])
    return met.select("mapping_id", "instance", "type", "field", F.coalesce("expression", F.lit("")).alias("expression"), sqltext.plain_rule(F.col("expression")).alias("rule")).distinct()


def terminal_kinds(trace: DataFrame, parent: DataFrame, facts: DataFrame) -> DataFrame:
    """What each trace ends in: source, sequence, constant or expression, unresolved."""
    ends = trace.join(parent.select("mapping_id", "node").distinct(), ["mapping_id", "node"], "left_anti").join(facts, ["mapping_id", "node"], "left")
    kind = F.when(F.col("type").isin("Source Definition", "Source Qualifier"), "source").when(F.col("type") == "Sequence", "sequence").when(F.trim(F.coalesce("expression", F.lit(""))) != "", "constant or expression").otherwise("unresolved")
    return ends.select("mapping_id", "start", kind.alias("kind")).distinct()


def logic_mismatch(detail: DataFrame, export: DataFrame) -> DataFrame:
    """Texts that differ between two sources once white space is folded, or that one of them lacks."""
    d = detail.select(*TEXT, sqltext.compact(F.col("value")).alias("detail"))
    e = export.select(*TEXT, sqltext.compact(F.col("value")).alias("export"))
    return d.join(e, TEXT, "full_outer").where(~F.col("detail").eqNullSafe(F.col("export")))


def fill_logic(detail: DataFrame, export: DataFrame) -> DataFrame:
    """The detail text, else the export's, with where it comes from."""
    rows = export.select(*TEXT, F.col("value").alias("from_export")).join(detail.select(*TEXT, F.col("value").alias("from_detail")), TEXT, "full_outer")
    return rows.select(*TEXT, F.coalesce("from_detail", "from_export").alias("value"), F.when(F.col("from_detail").isNotNull(), "detail").otherwise("export").alias("provenance"))


def eligibility_summary(conditions: DataFrame) -> DataFrame:
    """The distinct condition texts of a mapping as one list."""
    text = sqltext.compact(F.col("value"))
    rows = conditions.select("mapping_id", text.alias("rule")).distinct()
    return rows.groupBy("mapping_id").agg(F.count("*").alias("n_rules"), F.expr("listagg(rule, '; ') WITHIN GROUP (ORDER BY rule)").alias("rules"))
