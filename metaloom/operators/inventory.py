"""Inventory of workflows, mappings and transformation instances (family B)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Transformation types that have a detail extract: code to query name.
REGISTRY = {1: "SOURCE_DEFINITION", 2: "TARGET_DEFINITION", 3: "SOURCE_QUALIFIER", 5: "EXPRESSION", 6: "STORED_PROCEDURE", 7: "SEQUENCE", 9: "AGGREGATOR", 11: "LOOKUP", 12: "JOINER", 13: "FILTER", 14: "NORMALIZER", 15: "ROUTER", 16: "UPDATE_STRATEGY", 80: "SORTER", 97: "CUSTOM", 98: "TRANSACTION_CONTROL"}
SESSION_TASK = 68
MAPPLET = 44


def workflow_mappings(repo: dict[str, DataFrame], subject: str | None = None, workflow: str | None = None) -> DataFrame:
    """Distinct workflow, session instance and mapping, of session tasks only, in an optional scope."""
    tasks = repo["rep_task_inst"].where(F.col("task_type") == SESSION_TASK)
    workflows = scope(repo["rep_workflows"], subject, workflow)
    sessions = repo["rep_load_sessions"].select("session_id", "session_name", "mapping_id")
    out = workflows.join(tasks, "workflow_id").join(sessions, F.col("task_id") == F.col("session_id"))
    return out.select("subject_area", "subject_id", "workflow_name", F.col("instance_name").alias("session_instance_name"), "session_name", "mapping_id").distinct()


def scope(df: DataFrame, subject: str | None = None, workflow: str | None = None) -> DataFrame:
    """The subject area and workflow filters."""
    for column, value in (("subject_area", subject), ("workflow_name", workflow)):
        df = df if value is None else df.where(F.col(column) == value)
    return df


def scope_mapping(df: DataFrame, mappings: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose mapping is one of the named ones within the same subject (semi join, no names twice)."""
    wanted = mappings.join(names, "mapping_name", "left_semi").select("mapping_id", "subject_id")
    return df.join(wanted, ["mapping_id", "subject_id"], "left_semi")


def all_details(repo: dict[str, DataFrame], subject: str | None = None, workflow: str | None = None) -> DataFrame:
    """Every instance of every mapping in scope."""
    found = workflow_mappings(repo, subject, workflow)
    mappings = repo["rep_all_mappings"].select("mapping_id", "mapping_name")
    inst = repo["rep_widget_inst"].select("mapping_id", "subject_id", "instance_id", "instance_name", "widget_id", "widget_type", "widget_type_name", "version_number")
    return found.join(mappings, "mapping_id").join(inst, ["mapping_id", "subject_id"]).distinct()


def requested_names(df: DataFrame, column: str) -> DataFrame:
    """Comma lists to names; trimmed, first of those equal but for case, in order of mention."""
    parts = df.select(F.monotonically_increasing_id().alias("row"), F.posexplode(F.split(column, ",")).alias("pos", "name"))
    parts = parts.select(F.struct("row", "pos").alias("at"), F.trim("name").alias("name")).where("name <> ''")
    return parts.groupBy(F.lower("name").alias("folded")).agg(F.min("at").alias("at"), F.min_by("name", "at").alias("name"))


def missing_requested(names: DataFrame, details: DataFrame) -> DataFrame:
    """Requested names that no instance bears."""
    have = details.select(F.lower(F.trim("instance_name")).alias("folded"))
    return names.join(have, "folded", "left_anti").select("name")


def available_names(details: DataFrame, most: int = 30) -> DataFrame:
    """The first names, sorted, that an error lists beside the missing ones (the limit is the message's)."""
    first = details.select("instance_name").distinct().orderBy("instance_name").limit(most)
    return first.agg(F.expr("listagg(instance_name, ', ') WITHIN GROUP (ORDER BY instance_name)").alias("available"))


def restrict(details: DataFrame, names: DataFrame, columns: tuple[str, ...] = ("transformation_name", "lookup_transformation", "instance_name")) -> DataFrame:
    """Rows of the requested instances, by the first of the columns that the result has."""
    column = next(c for c in columns if c in details.columns)
    return details.join(names.select(F.col("folded").alias("__f")), F.lower(F.trim(column)) == F.col("__f"), "left_semi")


def canonical_type(column: str) -> Column:
    """Letters and digits of a type name, in upper case."""
    return F.upper(F.regexp_replace(column, "[^A-Za-z0-9]", ""))


#: Short names of types, in canonical form, and the names that they stand for (fixed values).
TYPE_ALIASES = {"LOOKUP": "LOOKUPPROCEDURE", "SEQUENCE": "SEQUENCEGENE", "SEQUENCEGENERATOR": "SEQUENCEGENE", "TARGET": "TARGETDEFINITION"}


def type_key(column: str) -> Column:
    """The canonical name, a short one replaced by what it stands for."""
    own = canonical_type(column)
    out = F.when(F.lit(False), own)
    for short, whole in TYPE_ALIASES.items():
        out = out.when(own == short, whole)
    return out.otherwise(own)


def query_for_type(types: DataFrame, aliases: DataFrame) -> DataFrame:
    """A type's query by its exact alias, else by the longest alias where either contains the other.

    types(type_name), aliases(alias, query): both small dimension tables by nature; the contains join is
    between distinct type names and aliases only.
    """
    names = types.select("type_name", canonical_type("type_name").alias("canon")).distinct()
    either = F.col("canon").contains(F.col("alias")) | F.col("alias").contains(F.col("canon"))
    rank = F.struct(F.col("canon") == F.col("alias"), F.length("alias"), "alias", "query")
    found = names.join(aliases, either & (F.length("canon") > 0), "left").groupBy("type_name").agg(F.max(F.when(F.col("alias").isNotNull(), rank)).alias("best"))
    return found.select("type_name", F.col("best.query").alias("query"))


def coverage_audit(details: DataFrame) -> DataFrame:
    """Instances and mappings per type, PRESENT where the type has an extract, else MISSING."""
    status = F.when(F.col("widget_type").isin(list(REGISTRY)), "PRESENT").otherwise("MISSING")
    return details.groupBy("widget_type", "widget_type_name").agg(F.countDistinct("mapping_id", "instance_id").alias("instances"), F.countDistinct("mapping_id").alias("mappings")).withColumn("status", status)


def instance_coverage(details: DataFrame) -> DataFrame:
    """Each instance of a mapping with its type, PRESENT where the type has an extract, else MISSING."""
    status = F.when(F.col("widget_type").isin(list(REGISTRY)), "PRESENT").otherwise("MISSING")
    return details.select("mapping_name", "instance_name", "widget_type_name", status.alias("status")).distinct()


def run_summary(spark, extracts: dict[str, Callable[[], DataFrame]], audit: DataFrame, subject: str | None = None, workflow: str | None = None) -> DataFrame:
    """A row for each extract, SUCCESS with its rows and mappings or FAILED without, and a MISSING row for each type in scope that has no extract.

    Each extract is an action of its own, so that one that fails leaves the others' rows. subject_scope and
    workflow_scope are the filters asked for, ALL without. message: the error of one that failed. audit: coverage_audit() of the scope.
    """
    rows = []
    for name, make in extracts.items():
        try:
            got = make().agg(F.count("*"), F.countDistinct("mapping_name")).first()
            rows.append((name, "SUCCESS", got[0], got[1], None))
        except Exception as error:  # whatever went wrong is this extract's status, and is told
            rows.append((name, "FAILED", None, None, f"{type(error).__name__}: {error}"))
    out = spark.createDataFrame(rows, "query_name string, status string, row_count long, mapping_count long, message string")
    missing = audit.where("status = 'MISSING'").select(F.col("widget_type_name").alias("query_name"), "status", F.lit(0).cast("long").alias("row_count"), "mappings", F.lit(None).cast("string"))
    return out.union(missing).select("query_name", "status", "row_count", "mapping_count", F.lit(subject or "ALL").alias("subject_scope"), F.lit(workflow or "ALL").alias("workflow_scope"), "message")


def combine_by_mapping(results: dict[str, DataFrame]) -> DataFrame:
    """All types' rows with their query name and the union of their columns; a column whose type differs between them becomes a string."""
    out, kinds = None, {}
    for df in results.values():
        for column, kind in df.dtypes:
            kinds.setdefault(column, set()).add(kind)
    for name, df in results.items():
        part = df.withColumns({c: F.col(c).cast("string") for c in df.columns if len(kinds[c]) > 1}).withColumn("query_name", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def leak_check(df: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of mappings that weren't asked for."""
    return df.join(names, "mapping_name", "left_anti")


def types_present(details: DataFrame) -> DataFrame:
    """Types in scope."""
    return details.select("widget_type_name").distinct()


def mapplet_instances(details: DataFrame) -> DataFrame:
    """Mapplet instances per workflow."""
    return details.where(F.col("widget_type").try_cast("int") == MAPPLET).groupBy("workflow_name").agg(F.count("*").alias("mapplets"))
