"""Exact run orders of workflows and mappings (family E), and what takes its ranks from them.

Tables: links (workflow_id, from_task, to_task, condition, ord), tasks (workflow_id, name, task_name, task_type, ord), sessions
(workflow_id, session_name, mapping_name, ord). ord is the place in the document. Blank names can't be linked and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.sources.store import cut

from . import agenda, overview

KEY, NO_CONDITION = ["workflow_id"], "[condition: none defined]"

#: Places of nodes of a later kind come after all of an earlier one.
_KIND = 1 << 40


def folded(text: Column) -> Column:
    """Names are matched without regard to case and width of white space."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def transformation_queue(inst: DataFrame, definitions: DataFrame, conn: DataFrame) -> DataFrame:
    """(mapping_id, transformation, place): definitions of a mapping in the order in which a queue over its connectors serves their instances.

    inst (mapping_id, instance, definition, ord), definitions (mapping_id, transformation, ord), conn (mapping_id, from_inst, to_inst, ord). Nodes
    are instances, then definitions, then connector ends, in document order. An instance counts for its definition, at its first
    place; definitions that no instance brings, and all of a mapping without connectors, come in document order.
    """
    key = ["mapping_id"]
    live = conn.where("from_inst <> '' and to_inst <> ''")
    ends = live.select(*key, F.explode(F.array(F.struct(F.col("from_inst").alias("node"), (2 * F.col("ord")).alias("ord")), F.struct(F.col("to_inst").alias("node"), (2 * F.col("ord") + 1).alias("ord")))).alias("e")).select(*key, "e.node", "e.ord")
    kinds = [inst.select(*key, F.col("instance").alias("node"), "ord"), definitions.select(*key, F.col("transformation").alias("node"), "ord"), ends]
    nodes = None
    for at, part in enumerate(kinds):
        part = part.where("node <> ''").select(*key, "node", (F.lit(at * _KIND) + F.col("ord")).alias("ord"))
        nodes = part if nodes is None else nodes.unionByName(part)
    nodes = nodes.join(live.select(*key).distinct(), key, "left_semi")
    queue = agenda.queue_order(nodes, live.select(*key, F.col("from_inst").alias("src"), F.col("to_inst").alias("dst"), "ord"), key)
    of = inst.groupBy(*key, F.col("instance").alias("node")).agg(F.max_by("definition", "ord").alias("definition"))
    served = queue.join(of, [*key, "node"], "left").groupBy(*key, F.coalesce(F.nullif("definition", F.lit("")), "node").alias("transformation")).agg(F.min("pos").alias("pos"))
    own = definitions.where("transformation <> ''").groupBy(*key, "transformation").agg(F.min("ord").alias("ord"))
    rows = own.join(served, [*key, "transformation"], "left")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("pos").asc_nulls_last(), "ord"))
    return rows.select(*key, "transformation", place.alias("place"))


def _live(links: DataFrame) -> DataFrame:
    return links.where("from_task <> '' and to_task <> ''")


def _begun(links: DataFrame) -> DataFrame:
    """Workflows with a link from Start."""
    return _live(links).where("from_task = 'Start'").select(*KEY).distinct()


def walked_links(links: DataFrame, tasks: DataFrame, sessions: DataFrame) -> DataFrame:
    """(workflow_id, pos, from_session, to_session, condition, mapping_name): links into sessions in the order of a depth-first walk from Start.

    Each (from, to, condition) is taken once, at its first place. A workflow without Start: all links, in document order.
    """
    live = cut(_live(links).withColumn("condition", F.coalesce("condition", F.lit(""))), "walk-links")
    once = live.join(_begun(links), KEY, "left_semi").groupBy(*KEY, "from_task", "to_task", "condition").agg(F.min("ord").alias("ord"))
    walk = agenda.walk_order(once.select(*KEY, F.col("from_task").alias("src"), F.col("to_task").alias("dst"), "ord"), KEY, "Start")
    rest = live.join(_begun(links), KEY, "left_anti")
    rest = rest.select(*KEY, "from_task", "to_task", "condition", F.row_number().over(Window.partitionBy(*KEY).orderBy("ord")).cast("long").alias("pos"))
    rows = once.join(walk, [*KEY, "ord"]).drop("ord").unionByName(rest)
    return _with_sessions(rows, tasks, sessions).select(*KEY, "pos", "from_session", "to_session", "condition", "mapping_name")


def _with_sessions(rows: DataFrame, tasks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Links into session tasks, with the sessions' names and mapping."""
    of = overview.task_sessions(tasks)
    rows = rows.join(of.select(*KEY, F.col("task").alias("to_task"), F.col("session_name").alias("to_session")), [*KEY, "to_task"])
    rows = rows.join(of.select(*KEY, F.col("task").alias("from_task"), F.col("session_name").alias("__from")), [*KEY, "from_task"], "left")
    rows = rows.join(overview.session_lookup(sessions).withColumnRenamed("session_name", "to_session"), "to_session", "left")
    return rows.withColumns({"from_session": F.coalesce("__from", "from_task"), "condition": F.coalesce(F.nullif("condition", F.lit("")), F.lit(NO_CONDITION)), "mapping_name": F.coalesce("mapping_name", F.lit(""))}).drop("__from")


def _task_nodes(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """(workflow_id, node, ord): Start, then tasks, then ends of links, in document order."""
    ends = links.select(*KEY, F.explode(F.array(F.struct(F.col("from_task").alias("node"), (2 * F.col("ord")).alias("ord")), F.struct(F.col("to_task").alias("node"), (2 * F.col("ord") + 1).alias("ord")))).alias("e")).select(*KEY, "e.node", (F.col("e.ord") + 2 * _KIND).alias("ord"))
    flows = tasks.select(*KEY).union(links.select(*KEY)).distinct()
    nodes = flows.select(*KEY, F.lit("Start").alias("node"), F.lit(0).cast("long").alias("ord")).unionByName(tasks.select(*KEY, F.col("name").alias("node"), (F.lit(_KIND) + F.col("ord")).alias("ord"))).unionByName(ends)
    return nodes.where("node <> ''").groupBy(*KEY, "node").agg(F.min("ord").alias("ord"))


def session_queue(links: DataFrame, tasks: DataFrame, sessions: DataFrame) -> DataFrame:
    """(workflow_id, place, to_session, from_session, condition, mapping_name): each session once, after all that it waits for.

    Tasks of all types are queued, of a workflow with Start only those that it reaches; followers are served in document order. Predecessors
    and conditions of all links into the session, each once, in document order.
    """
    live = cut(_live(links), "queue-links")
    nodes = cut(_task_nodes(tasks, links), "queue-nodes")
    edges = live.select(*KEY, F.col("from_task").alias("src"), F.col("to_task").alias("dst")).distinct().join(nodes.select(*KEY, F.col("node").alias("dst"), "ord"), [*KEY, "dst"])
    queue = agenda.queue_order(nodes, edges, KEY, start="Start")
    order = queue.join(overview.task_sessions(tasks).withColumnRenamed("task", "node"), [*KEY, "node"]).groupBy(*KEY, F.col("session_name").alias("to_session")).agg(F.min("pos").alias("pos"))
    fed = _with_sessions(live.select(*KEY, "from_task", "to_task", "condition", "ord"), tasks, sessions)
    listed = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.col(f"__{c}").alias("at"), F.col(c).alias("v")))), lambda s: s["v"]), sep)
    first = lambda c: F.min("ord").over(Window.partitionBy(*KEY, "to_session", c))
    fed = fed.withColumns({"__from_session": first("from_session"), "__condition": first("condition")})
    fed = fed.groupBy(*KEY, "to_session").agg(listed("from_session", ", ").alias("from_session"), listed("condition", " | ").alias("condition"))
    rows = order.join(fed, [*KEY, "to_session"], "left").join(overview.session_lookup(sessions).withColumnRenamed("session_name", "to_session"), "to_session", "left")
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("pos"))
    return rows.select(*KEY, place.alias("place"), "to_session", F.coalesce("from_session", F.lit("")).alias("from_session"), F.coalesce("condition", F.lit(NO_CONDITION)).alias("condition"), F.coalesce("mapping_name", F.lit("")).alias("mapping_name"))


def session_order(links: DataFrame, tasks: DataFrame) -> DataFrame:
    """(workflow_id, place, task, session_name, looped): session tasks, the ready one of the smallest document place first; links with other tasks don't count."""
    own = tasks.where((folded(F.col("task_type")) == "session") & (F.col("name") != ""))
    nodes = own.groupBy(*KEY, F.col("name").alias("node")).agg(F.max("ord").alias("ord"), F.max_by(F.coalesce(F.nullif("task_name", F.lit("")), "name"), "ord").alias("session_name"))
    edges = links.select(*KEY, F.col("from_task").alias("src"), F.col("to_task").alias("dst"), "ord")
    order = agenda.queue_order(nodes, edges, KEY, least=True)
    return order.join(nodes, [*KEY, "node"]).select(*KEY, F.col("pos").alias("place"), F.col("node").alias("task"), "session_name", "looped")


def session_ranks(links: DataFrame, tasks: DataFrame, sessions: DataFrame) -> DataFrame:
    """(mapping_name, rank, task): mappings numbered by their first mention, workflow after workflow, in the queue order of linked tasks.

    Links alone make the graph, a repeated one counts once; the first tasks are served in the order of the links that they begin. A workflow without links: tasks in document order. A task
    stands for its session's mapping, by its own name, else as a session's name. Ranks are given by ranges, so that no task holds all mappings.
    """
    live = cut(_live(links), "rank-links")
    begins, ends = live.groupBy(*KEY, F.col("from_task").alias("node")).agg(F.min("ord").alias("ord")), live.groupBy(*KEY, F.col("to_task").alias("node")).agg((F.min("ord") + _KIND).alias("ord"))
    queue = agenda.queue_order(begins.unionByName(ends), live.select(*KEY, F.col("from_task").alias("src"), F.col("to_task").alias("dst"), "ord"), KEY).select(*KEY, "node", "pos")
    alone = tasks.where("name <> ''").join(live.select(*KEY).distinct(), KEY, "left_anti").groupBy(*KEY, F.col("name").alias("node")).agg(F.min("ord").cast("long").alias("pos"))
    lookup = overview.session_lookup(sessions.where("mapping_name <> ''"))
    nested = tasks.where("name <> ''").withColumn("session_name", F.coalesce(F.nullif("task_name", F.lit("")), "name")).join(lookup, "session_name").groupBy(F.col("name").alias("node")).agg(F.max_by("mapping_name", "ord").alias("nested"))
    rows = queue.unionByName(alone).join(nested, "node", "left").join(lookup.select(F.col("session_name").alias("node"), "mapping_name"), "node", "left")
    rows = rows.withColumn("mapping_name", F.coalesce("nested", "mapping_name")).where("mapping_name is not null")
    first = rows.groupBy("mapping_name").agg(F.min(F.struct("workflow_id", "pos", "node")).alias("at"))
    return overview.numbered(first, "at").select("mapping_name", (F.col("n") - 1).alias("rank"), F.col("at.node").alias("task"))


def session_tables(links: DataFrame, inst: DataFrame, load: DataFrame) -> DataFrame:
    """(workflow_id, place, session_name, mapping_name, sources, targets): tables of each walked link's mapping, as lists in order.

    links: those of walked_links; mappings that the export doesn't hold are left out but keep their number. inst (mapping_name, instance, definition, type, ord), load
    (mapping_name, target_instance, ord). Sources in document order; targets by their load order where a mapping has one, else in document order.
    """
    source = inst.where("type = 'Source Definition' and definition <> ''").groupBy("mapping_name").agg(F.array_sort(F.collect_list(F.struct("ord", "definition"))).alias("s"))
    given = load.where("target_instance <> '' and ord <> ''").withColumn("given", F.col("ord").try_cast("int"))
    given = given.groupBy("mapping_name", F.col("target_instance").alias("instance")).agg(F.max("given").alias("given"))
    target = inst.where("type = 'Target Definition' and definition <> '' and instance <> ''").join(given, ["mapping_name", "instance"], "left").join(given.select("mapping_name").distinct().withColumn("some", F.lit(True)), "mapping_name", "left")
    target = target.where("given is not null or some is null").groupBy("mapping_name").agg(F.array_sort(F.collect_list(F.struct("given", "ord", "definition"))).alias("t"))
    known = inst.select("mapping_name").distinct().join(source, "mapping_name", "left").join(target, "mapping_name", "left")
    names = lambda c: F.array_join(F.transform(c, lambda s: s["definition"]), ", ")
    rows = links.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("pos"))).join(known, "mapping_name")
    return rows.select(*KEY, "place", F.col("to_session").alias("session_name"), "mapping_name", F.coalesce(names("s"), F.lit("")).alias("sources"), F.coalesce(names("t"), F.lit("")).alias("targets"))


def table_flow(tables: DataFrame) -> DataFrame:
    """(workflow_id, flow): sources and targets of the sessions in their order as one text."""
    part = F.concat_ws(" -> ", F.nullif("sources", F.lit("")), F.nullif("targets", F.lit("")))
    flow = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.regexp_replace(part, ", ", " -> ").alias("part")))), lambda s: F.nullif(s["part"], F.lit(""))), " -> ")
    return tables.groupBy(*KEY).agg(flow.alias("flow"))


def ranked_links(order: DataFrame, fields: DataFrame) -> DataFrame:
    """(workflow_id, session, table_name, field, n_links, links): source fields that a session earlier in the order writes.

    order: that of session_order with mapping_name; fields (mapping_name, side, table_name, field). Writers of a field are one sorted list, of which a reader takes the beginning
    before its own place: no reader is paired with writers that it doesn't name. Names are matched folded; a link is named once, in the writers' order.
    """
    rows = order.join(fields, "mapping_name").withColumns({"k1": folded(F.col("table_name")), "k2": folded(F.col("field"))})
    keys = [*KEY, "k1", "k2"]
    writers = rows.where("side = 'target'").groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("place", F.concat_ws(".", "task", "table_name", "field").alias("text")))).alias("writers"))
    readers = rows.where("side = 'source'").select(*keys, "place", "task", "table_name", "field").distinct()
    before = F.array_distinct(F.transform(F.filter("writers", lambda w: w["place"] < F.col("place")), lambda w: F.concat(w["text"], F.lit("->"), F.concat_ws(".", "task", "table_name", "field"))))
    found = readers.join(writers, keys).withColumn("found", before).where("size(found) > 0")
    return found.select(*KEY, F.col("task").alias("session"), "table_name", "field", F.size("found").cast("long").alias("n_links"), F.array_join("found", "\n").alias("links"))


def session_transformations(links: DataFrame, tasks: DataFrame, sessions: DataFrame, order: DataFrame) -> DataFrame:
    """(workflow_id, pos, session_name, mapping_name, place, transformation): each walked link's session with its mapping's transformations in their order.

    order (mapping_name, transformation, place). A session whose mapping has no transformation keeps one row with an empty text. An export without any workflow: every session once, with a null workflow, numbered in
    document order.
    """
    if links.isEmpty() and tasks.isEmpty():
        first = sessions.where("session_name <> ''").groupBy("session_name").agg(F.min("ord").alias("ord"))
        numbered = overview.numbered(first.join(overview.session_lookup(sessions), "session_name").withColumn("at", F.struct("ord", "session_name")), "at")
        rows = numbered.select(F.lit(None).cast(links.schema["workflow_id"].dataType).alias("workflow_id"), F.col("n").cast("long").alias("pos"), "session_name", F.coalesce("mapping_name", F.lit("")).alias("mapping_name"))
    else:
        rows = walked_links(links, tasks, sessions).select(*KEY, "pos", F.col("to_session").alias("session_name"), "mapping_name")
    return rows.join(order, "mapping_name", "left").select(*KEY, "pos", "session_name", "mapping_name", "place", F.coalesce("transformation", F.lit("")).alias("transformation"))
