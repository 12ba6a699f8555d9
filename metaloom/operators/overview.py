"""Run order of workflows and mappings (family E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.sources.store import cut

from . import graph

KEY = ["workflow_id"]


def reachable_tasks(links: DataFrame) -> DataFrame:
    """Tasks that a workflow's Start reaches; all linked tasks of a workflow without Start."""
    with_start = links.where("from_task = 'Start'").select("workflow_id", F.col("from_task").alias("start")).distinct()
    edges = links.select("workflow_id", F.col("from_task").alias("src"), F.col("to_task").alias("dst"))
    reached = graph.closure(with_start, edges, KEY).select("workflow_id", F.col("node").alias("task_name"))
    rest = links.join(with_start, KEY, "left_anti")
    every = rest.select("workflow_id", F.col("from_task").alias("task_name")).union(rest.select("workflow_id", "to_task")).distinct()
    return reached.unionByName(every)


def session_edges(links: DataFrame, tasks: DataFrame) -> DataFrame:
    """Direct links into sessions with their condition."""
    own = tasks.where("session_name is not null").select("workflow_id", F.col("task_name").alias("to_task"), "session_name")
    return links.join(own, [*KEY, "to_task"]).select("workflow_id", "from_task", F.col("session_name").alias("to_session"), F.coalesce("condition", F.lit("[condition: none defined]")).alias("condition"))


def session_order(links: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each reachable session's layer, with predecessors and conditions listed."""
    live = reachable_tasks(links)
    kept = links.join(live.withColumnRenamed("task_name", "from_task"), [*KEY, "from_task"], "left_semi")
    layered = graph.layers(live.select("workflow_id", F.col("task_name").alias("node")), kept.select("workflow_id", F.col("from_task").alias("src"), F.col("to_task").alias("dst")), KEY)
    fed = kept.groupBy("workflow_id", F.col("to_task").alias("task_name")).agg(
        F.expr("listagg(from_task, ', ') WITHIN GROUP (ORDER BY from_task)").alias("predecessors"),
        F.expr("listagg(coalesce(condition, '[condition: none defined]'), ' | ') WITHIN GROUP (ORDER BY from_task)").alias("conditions"),
    )
    sessions = tasks.where("session_name is not null").select("workflow_id", "task_name", "session_name")
    out = sessions.join(layered.withColumnRenamed("node", "task_name"), [*KEY, "task_name"]).join(fed, [*KEY, "task_name"], "left")
    return out.select("workflow_id", "session_name", "layer", "predecessors", "conditions")


def transformation_order(inst: DataFrame, conn: DataFrame) -> DataFrame:
    """Instances of a mapping by layer, then document order; without connectors, document order alone."""
    edges = conn.select("mapping_id", F.col("from_object_name").alias("src"), F.col("to_object_name").alias("dst")).distinct()
    nodes = inst.select("mapping_id", F.col("instance_name").alias("node"), F.col("instance_id").alias("ord"))
    return graph.topological_order(nodes, graph.layers(nodes, edges, ["mapping_id"]), ["mapping_id"])


def mapping_flow(order: DataFrame) -> DataFrame:
    """A mapping's transformations as one text in order."""
    return order.groupBy("mapping_id").agg(F.expr("listagg(node, ' -> ') WITHIN GROUP (ORDER BY pos)").alias("flow"))


def terminal_sessions(links: DataFrame, tasks: DataFrame) -> DataFrame:
    """Sessions that are no link's origin."""
    origins = links.select("workflow_id", F.col("from_task").alias("task_name"))
    return tasks.where("session_name is not null").join(origins, [*KEY, "task_name"], "left_anti").select("workflow_id", "session_name")


def session_tables(inst_table: DataFrame) -> DataFrame:
    """Source and target tables of a mapping as lists and as a flow."""
    listed = lambda t: F.array_join(F.array_sort(F.collect_set(F.when(F.col("widget_type") == t, F.col("table_name")))), ", ")
    out = inst_table.groupBy("mapping_id").agg(listed(1).alias("sources"), listed(2).alias("targets"))
    return out.withColumn("flow", F.concat_ws(" -> ", "sources", "targets"))


def session_lookup(sessions: DataFrame) -> DataFrame:
    """The mapping of each session name; its last definition wins."""
    return sessions.where("session_name <> ''").groupBy("session_name").agg(F.max_by("mapping_name", "ord").alias("mapping_name"))


def mapping_registry(mappings: DataFrame) -> DataFrame:
    """Mapping names at the place of their first mention, with the last definition's place."""
    return mappings.where("mapping_name <> ''").groupBy("mapping_name").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


def distinct_in_order(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Values without blanks, each at its first place."""
    return rows.where(F.coalesce(F.trim(value), F.lit("")) != "").groupBy(*keys, value).agg(F.min(order).alias(order))


def task_sessions(tasks: DataFrame) -> DataFrame:
    """Session of each task, by the instance's name and by the task's own name; session tasks only, the last of equal names."""
    own = tasks.where("task_type = 'Session'").withColumn("session_name", F.coalesce(F.nullif("task_name", F.lit("")), "name"))
    rows = own.select("workflow_id", F.col("name").alias("task"), "session_name", "ord").union(own.select("workflow_id", "task_name", "session_name", "ord"))
    return rows.where("task <> ''").groupBy("workflow_id", "task").agg(F.max_by("session_name", F.struct("ord", "session_name")).alias("session_name"))


def linked_sessions(links: DataFrame, tasks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Links into sessions that Start reaches (all links of a workflow without Start), each (from, to, condition) once, with the mapping."""
    live = links.where("from_task <> '' and to_task <> ''")
    begun = live.where("from_task = 'Start'").select("workflow_id").distinct()
    reached = reachable_tasks(live).select("workflow_id", F.col("task_name").alias("from_task"))
    walked = live.join(begun, KEY, "left_semi").join(reached, [*KEY, "from_task"], "left_semi").groupBy("workflow_id", "from_task", "to_task", "condition").agg(F.min("ord").alias("ord"))
    rows = walked.unionByName(live.join(begun, KEY, "left_anti").select("workflow_id", "from_task", "to_task", "condition", "ord"))
    to = task_sessions(tasks).select("workflow_id", F.col("task").alias("to_task"), F.col("session_name").alias("to_session"))
    of = task_sessions(tasks).select("workflow_id", F.col("task").alias("from_task"), F.col("session_name").alias("from_session"))
    rows = rows.join(to, [*KEY, "to_task"]).join(of, [*KEY, "from_task"], "left").join(session_lookup(sessions).withColumnRenamed("session_name", "to_session"), "to_session", "left")
    condition = F.coalesce(F.nullif("condition", F.lit("")), F.lit("[condition: none defined]"))
    return rows.select("workflow_id", F.coalesce("from_session", "from_task").alias("from_session"), "to_session", condition.alias("condition"), F.coalesce("mapping_name", F.lit("")).alias("mapping_name"), "ord")


def mapping_transformations(order: DataFrame, mappings: DataFrame) -> DataFrame:
    """Every mapping with its transformations in order, blank for a mapping without; the mapping's name in the first row only."""
    rows = mappings.join(order, "mapping_id", "left")
    return rows.select("mapping_id", F.when(F.coalesce("pos", F.lit(1)) == 1, F.col("mapping_name")).otherwise("").alias("shown_mapping"), F.coalesce("node", F.lit("")).alias("transformation"), "pos")


def load_order(inst: DataFrame, order: DataFrame) -> DataFrame:
    """Targets of a mapping by their load order (the last one given); unknown instances are dropped, targets without come after, in document order."""
    given = order.where("target_instance <> '' and ord <> ''").groupBy("mapping_id", F.col("target_instance").alias("instance")).agg(F.max(F.col("ord").try_cast("int")).alias("given"))
    rows = inst.where("type = 'Target Definition'").join(given, ["mapping_id", "instance"], "left")
    at = F.row_number().over(Window.partitionBy("mapping_id").orderBy(F.col("given").asc_nulls_last(), "ord"))
    return rows.select("mapping_id", "instance", "given", at.alias("place"))


def file_exports(extensions: DataFrame) -> DataFrame:
    """Writers to files with the file's name and directory, where either is set."""
    pick = lambda n: F.coalesce(F.max(F.when(F.col("name") == n, F.col("value"))), F.lit(""))
    rows = extensions.where("type = 'WRITER' and subtype like '%File%' and instance <> ''").groupBy("session_name", "ord", "instance", "subtype").agg(pick("Output filename").alias("file_name"), pick("Output file directory").alias("directory"))
    return rows.where("file_name <> '' or directory <> ''").drop("ord")


def terminal_mappings(tasks: DataFrame, links: DataFrame, sessions: DataFrame) -> DataFrame:
    """Mappings of enabled session tasks, by either name, that are no link's origin in their workflow."""
    live = tasks.where((F.upper("task_type") == "SESSION") & (F.upper(F.coalesce("isenabled", F.lit("YES"))) == "YES"))
    names = live.select("workflow_id", F.col("task_name").alias("session_name")).union(live.select("workflow_id", "name")).where("session_name <> ''").distinct()
    origins = links.where("from_task <> ''").select("workflow_id", F.col("from_task").alias("session_name"))
    of = sessions.where("session_name <> '' and mapping_name <> ''").groupBy("session_name").agg(F.max_by("mapping_name", "ord").alias("mapping_name"))
    return names.join(origins, [*KEY, "session_name"], "left_anti").join(of, "session_name").select("workflow_id", "session_name", "mapping_name")


def effective_attributes(attr: DataFrame, inst: DataFrame) -> DataFrame:
    """attributes under the instance's name and under its definition's; of instances that share a definition, the last in document order."""
    rows = attr.select("mapping_id", "instance", "name", "value").join(inst.select("mapping_id", "instance", "definition", "ord"), ["mapping_id", "instance"])
    own = rows.select("mapping_id", F.col("instance").alias("owner"), "name", "value", F.lit(1 << 40).alias("at"))
    shared = rows.where("definition != instance").select("mapping_id", F.col("definition").alias("owner"), "name", "value", F.col("ord").cast("long").alias("at"))
    return own.unionByName(shared).groupBy("mapping_id", "owner", "name").agg(F.max_by("value", "at").alias("value"))


def mapping_ranks(links: DataFrame, sessions: DataFrame) -> DataFrame:
    """The place of each mapping's first mention in the links, mappings that no link runs after them in document order.

    Numbered by range partitions with the counts of those before, so that no task holds all mappings.
    """
    first = links.where("mapping_name <> ''").groupBy("mapping_name").agg(F.min("ord").alias("linked"))
    rows = sessions.where("mapping_name <> ''").groupBy("mapping_name").agg(F.min("ord").alias("ord")).join(first, "mapping_name", "left")
    rows = rows.select("mapping_name", F.struct(F.col("linked").isNull(), "linked", F.least("ord", "linked").alias("ord"), "mapping_name").alias("at"))
    return numbered(rows, "at").select("mapping_name", F.col("n").alias("rank"))


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with their place n (from 1) in the order of a column that has no ties."""
    dealt = cut(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("size"))
    before = sizes.select("__part", (F.sum("size").over(Window.orderBy("__part")) - F.col("size")).alias("before"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("__part").orderBy(by))
    return dealt.withColumn("__n", within).join(before, "__part").withColumn("n", F.col("before") + F.col("__n")).drop("__part", "__n", "before")
