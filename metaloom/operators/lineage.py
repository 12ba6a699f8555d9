"""Port graph, tracers and what hangs on them (families F, G, H, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions import sqltext
from metaloom.sources.store import cut

from . import graph

SOURCE, TARGET, QUALIFIER = 1, 2, 3
#: Types whose expressions say nothing of where a port comes from: connectors are always followed.
OPAQUE = (97,)
KEY = ["mapping_id"]
#: Paths to a target that one task may list, one after the other.
WALK_PATHS = 100_000


def _node(instance: str, field: str):
    return F.concat_ws(".", F.col(instance).cast("string"), F.col(field))


def edges(conn: DataFrame) -> DataFrame:
    """port edges; rows with a blank end are dropped."""
    full = F.lit(True)
    for c in ("from_object_field_name", "to_object_field_name", "from_object_name", "to_object_name"):
        full = full & (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return conn.where(full).select("mapping_id", _node("from_object_instance_id", "from_object_field_name").alias("src"), _node("to_object_instance_id", "to_object_field_name").alias("dst")).distinct()


def degrees(edge: DataFrame) -> DataFrame:
    """ports by how many ports they feed and are fed by."""
    out = edge.select("mapping_id", F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    inc = edge.select("mapping_id", F.col("dst").alias("node"), F.lit(0), F.lit(1))
    return out.union(inc).groupBy("mapping_id", "node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def role(widget_type: str = "widget_type"):
    """what an instance is to lineage."""
    t = F.col(widget_type)
    return F.when(t.isin(SOURCE, QUALIFIER), "source").when(t == TARGET, "target").when(t == 11, "lookup").when(t.isin(13, 15), "filter").otherwise("transformation")


def ports(repo: dict[str, DataFrame]) -> DataFrame:
    """Every port with its expression text (lines joined) and its instance's type."""
    texts = repo["opb_widget_expr"].join(repo["opb_expression"], ["widget_id", "version_number", "expr_id"])
    texts = texts.groupBy("widget_id", F.col("output_field_id").alias("field_id")).agg(F.expr("listagg(expression, '\n') WITHIN GROUP (ORDER BY line_no)").alias("expression"))
    out = repo["rep_widget_inst"].select("mapping_id", "instance_id", "instance_name", "widget_id", "widget_type", "widget_type_name").join(repo["opb_widget_field"].select("widget_id", "field_id", "field_name", "porttype"), "widget_id")
    return out.join(texts, ["widget_id", "field_id"], "left").withColumn("node", _node("instance_id", "field_name"))


def port_deps(port: DataFrame) -> DataFrame:
    """ports of the same instance that an expression names, itself aside."""
    named = port.where("expression is not null").select("mapping_id", "instance_id", "node", F.explode(sqltext.field_tokens(F.col("expression"))).alias("token"))
    same = port.select("mapping_id", "instance_id", F.upper("field_name").alias("token"), F.col("node").alias("dep"))
    return named.join(same, ["mapping_id", "instance_id", "token"]).where("node != dep").select("mapping_id", "node", "dep").distinct()


def stop_ports(port: DataFrame) -> DataFrame:
    """ports whose own expression, not a pass-through, ends the walk over connectors."""
    passes = sqltext.is_pass_through(F.col("expression"), F.col("field_name"))
    return port.where(~passes & ~F.col("widget_type").isin(*OPAQUE)).select("mapping_id", "node")


def parent_edges(edge: DataFrame, port: DataFrame) -> DataFrame:
    """from a port to what it comes from: connectors unless stopped, and ports that its expression names."""
    back = edge.select("mapping_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    walked = back.join(stop_ports(port).withColumnRenamed("node", "src"), ["mapping_id", "src"], "left_anti")
    return walked.unionByName(port_deps(port).select("mapping_id", F.col("node").alias("src"), F.col("dep").alias("dst"))).distinct()


def target_ports(edge: DataFrame, port: DataFrame) -> DataFrame:
    """connected ports of target instances."""
    fed = edge.select("mapping_id", F.col("dst").alias("node")).distinct()
    return port.where(F.col("widget_type") == TARGET).select("mapping_id", "node").join(fed, ["mapping_id", "node"], "left_semi").distinct()


def reachable_from_targets(edge: DataFrame, targets: DataFrame) -> DataFrame:
    """(mapping, start, node) over connectors alone, against their direction."""
    back = edge.select("mapping_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.closure(targets.select("mapping_id", F.col("node").alias("start")), back, KEY)


def trace_back(edge: DataFrame, port: DataFrame, targets: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """every port that each target port comes from, with its distance. parents: the parent edges, where they are already written."""
    return graph.closure(targets.select("mapping_id", F.col("node").alias("start")), parent_edges(edge, port) if parents is None else parents, KEY)


def lineage_records(trace: DataFrame, parents: DataFrame, port: DataFrame) -> DataFrame:
    """one record for each target port: ports visited, its sources, transformations, and the first rule on the way."""
    leaf = parents.select("mapping_id", F.col("src").alias("node")).distinct().withColumn("goes_on", F.lit(True))
    facts = port.select("mapping_id", "node", "instance_name", "field_name", role().alias("role"), "widget_type_name", "expression", (~sqltext.is_pass_through(F.col("expression"), F.col("field_name"))).alias("is_rule"))
    rows = trace.join(facts, [*KEY, "node"]).join(leaf, [*KEY, "node"], "left")
    source = (F.col("role") == "source") & F.col("goes_on").isNull()
    rule = F.when(F.col("is_rule"), F.struct("depth", "node", "expression"))
    return rows.groupBy("mapping_id", "start").agg(
        F.count("*").alias("n_visited"),
        F.array_join(F.array_sort(F.collect_set(F.when(source, F.concat_ws(".", "instance_name", "field_name")))), ", ").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("widget_type_name")), ", ").alias("types"),
        F.count_if(F.col("role") == "lookup").alias("n_lookups"),
        F.min(rule).alias("rule"),
    ).select("mapping_id", "start", "n_visited", "sources", "types", "n_lookups", sqltext.compact(sqltext.without_comments(F.col("rule.expression"))).alias("primary_rule"))


def completeness(records: DataFrame, port: DataFrame, reach: DataFrame) -> DataFrame:
    """Fields of targets expected and traced, ports reachable over connectors, and whether all is there."""
    expected = port.where(F.col("widget_type") == TARGET).groupBy("mapping_id").agg(F.countDistinct("node").alias("expected_fields"))
    actual = records.groupBy("mapping_id").agg(F.countDistinct("start").alias("actual_fields"), F.sum(F.when(F.col("sources") == "", 1).otherwise(0)).alias("without_source"))
    ports_reached = reach.groupBy("mapping_id").agg(F.countDistinct("node").alias("reachable_ports"))
    out = expected.join(actual, KEY, "left").join(ports_reached, KEY, "left").fillna(0)
    return out.withColumn("is_complete", (F.col("expected_fields") == F.col("actual_fields")) & (F.col("without_source") == 0))


def assert_complete(report: DataFrame) -> None:
    """raises when a mapping is incomplete."""
    first = report.where(~F.col("is_complete")).orderBy("mapping_id").limit(1).collect()
    if first:
        raise ValueError(f"lineage of mapping {first[0]['mapping_id']} is incomplete: {first[0].asDict()}")


def unresolved(trace: DataFrame, parents: DataFrame, port: DataFrame) -> DataFrame:
    """ports where a trace ends without being a source."""
    ends = trace.select("mapping_id", "node").distinct().join(parents.select("mapping_id", F.col("src").alias("node")).distinct(), [*KEY, "node"], "left_anti")
    return ends.join(port.select("mapping_id", "node", "instance_name", "field_name", role().alias("role")), [*KEY, "node"]).where("role != 'source'").select("mapping_id", "instance_name", "field_name")


def paths(edge: DataFrame, port: DataFrame) -> DataFrame:
    """simple forward paths from ports that nothing feeds, or of source definitions, to target ports."""
    return graph.forward_paths(edge, *path_ends(edge, port), KEY)


def path_ends(edge: DataFrame, port: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where forward paths start and end."""
    fed = edge.select("mapping_id", F.col("dst").alias("node")).distinct()
    starts = edge.select("mapping_id", F.col("src").alias("node")).distinct()
    sources = port.where(F.col("widget_type") == SOURCE).select("mapping_id", "node")
    return starts.join(fed, [*KEY, "node"], "left_anti").unionByName(starts.join(sources, [*KEY, "node"], "left_semi")).distinct(), target_ports(edge, port)


def path_forecast(edge: DataFrame, port: DataFrame, many: int = 10_000) -> DataFrame:
    """(mapping_id, target, n_paths, longest, looped, explodes): what enumerating a target field's paths would give, known beforehand; explodes: more than `many` paths, or a cycle before it."""
    counts = graph.path_counts(edge, *path_ends(edge, port), KEY)
    return counts.withColumn("explodes", F.col("looped") | (F.col("n_paths") > many))


def paths_by_target(edge: DataFrame, port: DataFrame, many: int = 10_000) -> DataFrame:
    """all paths; those of targets that the forecast calls exploding are found from the target back, apart from the others, whose mappings they would swell."""
    starts, ends = path_ends(edge, port)
    told = cut(path_forecast(edge, port, many), "forecast")
    listed = lambda condition: told.where(condition).select("mapping_id", F.col("target").alias("node"))
    light = ends.join(listed("explodes"), [*KEY, "node"], "left_anti")
    # ways to heavy targets alone are left out of the forward walk: only what reaches a light one is walked
    back = graph.spread(light.select("mapping_id", "node"), edge.select("mapping_id", F.col("dst").alias("src"), F.col("src").alias("dst")), KEY)
    kept = edge.join(back.withColumnRenamed("node", "dst"), ["mapping_id", "dst"], "left_semi")
    few = graph.WALK_ROWS if many <= WALK_PATHS else 0
    found = graph.forward_paths(kept, starts, light, KEY, bound=few)
    some, more = listed(f"explodes and n_paths <= {WALK_PATHS}"), listed(f"explodes and (looped or n_paths > {WALK_PATHS})")
    for targets, bound in ((some, graph.WALK_ROWS), (more, 0)):
        if not targets.isEmpty():
            of = edge.join(targets.select("mapping_id").distinct(), KEY, "left_semi")
            found = found.unionByName(graph.backward_paths(of, starts, targets, ends, KEY, bound=bound))
    return found


def path_rows(path: DataFrame, port: DataFrame) -> DataFrame:
    """One row for each transformation on a path (the source where there is none), the path as text, its hops."""
    rows = path.withColumns({"full_path": F.array_join("path", " -> "), "source": F.element_at("path", 1), "target": F.element_at("path", -1), "hops": F.size("path") - 1})
    rows = rows.select("mapping_id", "full_path", "source", "target", "hops", F.posexplode("path").alias("pos", "node"))
    facts = port.select("mapping_id", "node", "widget_type", "instance_name", "widget_type_name", "field_name")
    rows = rows.join(facts, [*KEY, "node"]).withColumn("inner", (F.col("pos") > 0) & (F.col("pos") < F.col("hops")) & ~F.col("widget_type").isin(SOURCE, TARGET))
    some = F.max("inner").over(Window.partitionBy("mapping_id", "full_path"))
    return rows.withColumn("some", some).where("inner or (not some and pos = 0)").select("mapping_id", "full_path", "source", "target", "hops", F.col("instance_name").alias("transformation"), F.col("widget_type_name").alias("transformation_type"), "field_name")


def paths_per_field(path: DataFrame) -> DataFrame:
    """Every target field with its distinct paths of instances, numbered in text order."""
    seq = F.array_join(F.transform("path", lambda x: F.split(x, r"\.")[0]), " -> ")
    rows = path.select("mapping_id", F.element_at("path", -1).alias("target"), seq.alias("seq")).distinct()
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("mapping_id", "target").orderBy("seq")))
    text = F.expr("listagg(concat('Path', cast(n as string), ': ', seq), '; ') WITHIN GROUP (ORDER BY n)")
    return numbered.groupBy("mapping_id", "target").agg(F.count("*").alias("n_paths"), text.alias("paths"))


def table_fields(inst_table: DataFrame, port: DataFrame) -> DataFrame:
    return port.select("mapping_id", "instance_id", "node", "field_name").join(inst_table.select("mapping_id", "instance_id", "widget_type", "table_name"), ["mapping_id", "instance_id"])


def cross_session_links(fields: DataFrame) -> DataFrame:
    """source fields whose table and field an earlier session's target has; the session's place is its mapping id.

    The writers of a table's field are one text, in their order. Readers and writers are put in one order too, so that a reader knows how many writers come before it: its links are the beginning of that text.
    No pairs are gathered; the texts name every pair, so what is written grows with the pairs.
    """
    key = ["table_name", "field_name"]
    read = fields.where(F.col("widget_type") == SOURCE).select(*key, F.col("mapping_id").alias("at")).distinct()
    writers = fields.where((F.col("widget_type") == TARGET) & F.col("mapping_id").isNotNull()).select(*key, F.col("mapping_id").alias("at")).distinct()
    before = Window.partitionBy(*key).orderBy("at", "writes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = read.withColumn("writes", F.lit(0)).union(writers.withColumn("writes", F.lit(1))).withColumn("n_links", F.sum("writes").over(before))
    link = lambda w: F.concat_ws(".", F.concat(F.lit("m_"), w.cast("string")), *key)
    texts = writers.groupBy(*key).agg(F.array_sort(F.collect_list("at")).alias("writers")).select(*key, F.array_join(F.transform("writers", link), "\n").alias("text"))
    lines = 1 + F.length(F.regexp_replace(F.concat(*key), r"[^\n]", ""))  # of a link, should a name have several
    found = line.where("writes = 0 and n_links > 0").join(texts, key)
    return found.select(F.col("at").alias("reader"), *key, "n_links", F.call_function("substring_index", "text", F.lit("\n"), (F.col("n_links") * lines).cast("int")).alias("links"))


def table_writers(inst_table: DataFrame) -> DataFrame:
    """Which mappings write a table."""
    return inst_table.where(F.col("widget_type") == TARGET).select("table_name", F.col("mapping_id").alias("writer")).distinct()


def upstream_mapping(inst_table: DataFrame) -> DataFrame:
    """For each table that a mapping reads, its writer: the only one, else the latest earlier one, else the latest, which is flagged.

    Readers and writers of a table are put in one order, and each reader takes the last writer before it: no pairs are made.
    """
    read = inst_table.where(F.col("widget_type") == SOURCE).select("table_name", F.col("mapping_id").alias("reader")).distinct()
    writers = table_writers(inst_table)
    by_age = F.row_number().over(Window.partitionBy("table_name").orderBy(F.desc("writer")))
    per = writers.withColumn("age", by_age).groupBy("table_name").agg(F.count("*").alias("n"), F.max("writer").alias("latest"), F.max(F.when(F.col("age") == 2, F.col("writer"))).alias("second"))
    none = F.lit(None).cast("long")
    line = read.select("table_name", F.col("reader").alias("at"), F.lit(0).alias("kind"), none.alias("writer")).union(writers.select("table_name", "writer", F.lit(1), "writer"))
    before = Window.partitionBy("table_name").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn("earlier", F.last("writer", ignorenulls=True).over(before)).where("kind = 0").select("table_name", F.col("at").alias("reader"), "earlier")
    own = writers.select("table_name", F.col("writer").alias("reader"), F.lit(1).alias("own"))
    rows = line.join(per, "table_name").join(own, ["table_name", "reader"], "left").withColumn("n_writers", F.col("n") - F.coalesce("own", F.lit(0)))
    latest = F.when(F.col("latest") == F.col("reader"), F.col("second")).otherwise(F.col("latest"))
    return rows.where("n_writers > 0").select("reader", "table_name", "n_writers", F.coalesce("earlier", latest).alias("upstream"), (F.col("earlier").isNull() & (F.col("n_writers") > 1)).alias("ambiguous"))


def mapping_summary(records: DataFrame) -> DataFrame:
    """Target fields of a mapping, with rules, with lookups."""
    return records.groupBy("mapping_id").agg(F.count("*").alias("fields"), F.count("primary_rule").alias("with_rule"), F.count_if(F.col("n_lookups") > 0).alias("with_lookup"))


def type_counts(records: DataFrame) -> DataFrame:
    """Records by transformation type."""
    return records.select(F.explode(F.split("types", ", ")).alias("type")).groupBy("type").agg(F.count("*").alias("n"))

