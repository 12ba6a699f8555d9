"""Queries of the graph, lineage, overview and text operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions import sqltext
from metaloom.operators import blocks, inventory, lineage, overview
from metaloom.sources.fixture import repository, with_sql
from metaloom.sources.store import cut, keeps_texts_once


def _graph(spark, d):
    repo = repository(spark, d)
    edge, port = cut(lineage.edges(repo["rep_mapping_conn_ports"]), "edge"), cut(lineage.ports(repo), "port")
    return repo, edge, port


def _trace(spark, d):
    repo, edge, port = _graph(spark, d)
    parents = cut(lineage.parent_edges(edge, port), "parents")
    targets = cut(lineage.target_ports(edge, port), "target-ports")
    return repo, edge, port, parents, targets, lineage.trace_back(edge, port, targets, parents)


def f01(spark, d):
    return lineage.edges(repository(spark, d)["rep_mapping_conn_ports"])


def f02(spark, d):
    return repository(spark, d)["rep_widget_inst"].select("mapping_id", "instance_id", lineage.role().alias("role"))


def f05(spark, d):
    return lineage.port_deps(lineage.ports(repository(spark, d)))


def f07(spark, d):
    return lineage.degrees(lineage.edges(repository(spark, d)["rep_mapping_conn_ports"]))


def f08(spark, d):
    _, edge, port = _graph(spark, d)
    return lineage.reachable_from_targets(edge, lineage.target_ports(edge, port)).select("mapping_id", "start", "node")


def f09(spark, d):
    return _trace(spark, d)[5].select("mapping_id", "start", "node")


def f11(spark, d):
    return lineage.stop_ports(lineage.ports(repository(spark, d)))


def f25(spark, d):
    _, _, port, parents, _, trace = _trace(spark, d)
    return lineage.unresolved(trace, parents, port)


def _records(spark, d):
    _, edge, port, parents, targets, trace = _trace(spark, d)
    return edge, port, lineage.lineage_records(trace, parents, port), targets


def f31(spark, d):
    return _records(spark, d)[2]


def f33(spark, d):
    edge, port, records, targets = _records(spark, d)
    return lineage.completeness(records, port, lineage.reachable_from_targets(edge, targets))


def h02(spark, d):
    return lineage.type_counts(_records(spark, d)[2])


def h03(spark, d):
    return lineage.mapping_summary(_records(spark, d)[2])


def f42(spark, d):
    _, edge, port = _graph(spark, d)
    return lineage.paths(edge, port).select("mapping_id", F.array_join("path", " -> ").alias("path"))


def f42_forecast(spark, d):
    _, edge, port = _graph(spark, d)
    return lineage.path_forecast(edge, port, 3)


def f42_split(spark, d):
    _, edge, port = _graph(spark, d)
    return lineage.paths_by_target(edge, port, 3).select("mapping_id", F.array_join("path", " -> ").alias("path"))


def f43(spark, d):
    _, edge, port = _graph(spark, d)
    return lineage.path_rows(lineage.paths(edge, port), port)


def i01(spark, d):
    _, edge, port = _graph(spark, d)
    return lineage.paths_per_field(lineage.paths(edge, port))


def f47(spark, d):
    keeps_texts_once(spark)
    repo = repository(spark, d)
    return lineage.cross_session_links(lineage.table_fields(repo["inst_table"], lineage.ports(repo)))


def g06(spark, d):
    return lineage.table_writers(repository(spark, d)["inst_table"])


def g07(spark, d):
    return lineage.upstream_mapping(repository(spark, d)["inst_table"])


def e03(spark, d):
    repo = repository(spark, d)
    return overview.transformation_order(repo["rep_widget_inst"], repo["rep_mapping_conn_ports"]).select("mapping_id", "node", "layer", "pos")


def e17(spark, d):
    repo = repository(spark, d)
    return overview.mapping_flow(overview.transformation_order(repo["rep_widget_inst"], repo["rep_mapping_conn_ports"]))


def e08(spark, d):
    repo = repository(spark, d)
    return overview.session_order(cut(repo["workflow_link"], "links"), repo["task"])


def e09(spark, d):
    return overview.reachable_tasks(cut(repository(spark, d)["workflow_link"], "links"))


def e10(spark, d):
    repo = repository(spark, d)
    return overview.session_edges(repo["workflow_link"], repo["task"])


def e21(spark, d):
    return overview.session_tables(repository(spark, d)["inst_table"])


def e25(spark, d):
    repo = repository(spark, d)
    return overview.terminal_sessions(repo["workflow_link"], repo["task"])


def _sql(spark, d):
    return repository(spark, d)["rep_widget_attr"].where("attr_value like 'SELECT%'").select("widget_id", "attr_id", F.col("attr_value").alias("sql"))


def f39(spark, d):
    items = _sql(spark, d).select("widget_id", "attr_id", F.posexplode(sqltext.select_items(F.col("sql"))).alias("pos", "item"))
    return items.withColumn("alias", sqltext.alias_of(F.col("item")))


def g22(spark, d):
    return _sql(spark, d).select("widget_id", "attr_id", sqltext.where_clause(F.col("sql")).alias("where_text"))


def g23(spark, d):
    return _sql(spark, d).select("widget_id", "attr_id", F.array_join(sqltext.sql_tables(F.col("sql")), ",").alias("tables"))


def i12(spark, d):
    return _sql(spark, d).select("widget_id", "attr_id", F.array_join(sqltext.table_aliases(F.col("sql")), ",").alias("aliases"))


def g12(spark, d):
    rows = repository(spark, d)["opb_expression"]
    return rows.select("widget_id", "expr_id", "line_no", F.array_join(sqltext.field_tokens(F.col("expression")), ",").alias("tokens"))


def d02b(spark, d):
    rows = repository(spark, d)["rep_widget_attr"].where("upper(attr_name) = 'LOOKUP CONDITION' and trim(attr_value) <> ''")
    parts = rows.select("widget_id", F.posexplode(sqltext.condition_rows(F.col("attr_value"))).alias("pos", "condition"))
    left, op, right = sqltext.condition_parts(F.col("condition"))
    return parts.select("widget_id", (F.col("pos") + 1).alias("condition_order"), "condition", left.alias("lookup_column"), op.alias("operator"), right.alias("port"))


def d05a(spark, d):
    repo = repository(spark, d)
    rel = blocks.relevant(inventory.all_details(repo).where("widget_type = 3"))
    inc = blocks.incoming(rel, repo["rep_mapping_conn_ports"]).select("mapping_id", "instance_id", "object_name").distinct()
    return inc.groupBy("mapping_id", "instance_id").agg(F.expr("listagg(object_name, ', ') WITHIN GROUP (ORDER BY object_name)").alias("associated_sources"))


def _normalizer(spark, d):
    repo = repository(spark, d)
    rel = blocks.relevant(inventory.all_details(repo).where("widget_type = 14"))
    ports = rel.join(repo["opb_widget_field"], ["widget_id", "version_number"])
    name = F.col("field_name")
    kind = F.when(name.rlike("(?i)_in[0-9]*$"), "INPUT_OCCURRENCE").when(F.upper(name).like("GK_%"), "GENERATED_KEY").when(F.upper(name).like("GCID_%"), "GENERATED_COLUMN_ID").otherwise("OUTPUT")
    return ports.select(*blocks.KEYS, "field_order", "field_name", "wgt_datatype", "wgt_prec", "wgt_scale", F.regexp_replace(name, "(?i)_in[0-9]*$", "").alias("column_name"), kind.alias("category"))


def d11a(spark, d):
    return _normalizer(spark, d).select("instance_id", "field_name", "column_name", "category")


def d11b(spark, d):
    rows = _normalizer(spark, d).where("category in ('INPUT_OCCURRENCE', 'OUTPUT')")
    inputs, outputs = F.col("category") == "INPUT_OCCURRENCE", F.col("category") == "OUTPUT"
    n = F.count_if(inputs)
    return rows.groupBy("instance_id", "column_name").agg(F.min(F.when(inputs, F.col("field_order"))).alias("first_order"), F.when(n > 1, n).otherwise(0).alias("occurs"), F.max(F.when(outputs, F.col("wgt_datatype"))).alias("datatype_code"), F.max(F.when(outputs, F.col("wgt_prec"))).alias("prec"))


def d12a(spark, d):
    rows = repository(spark, d)["opb_table_group"].where("object_type = 15")
    pick = lambda a: F.max(F.when(F.col("attr_id") == a, F.trim("attr_value")))
    return rows.groupBy("object_id", "version_number", "group_id").agg(pick(1).alias("group_name"), pick(3).alias("group_condition"))


def d13b(spark, d):
    repo = repository(spark, d)
    keyed = repo["opb_widget_expr"].where("expr_type = 46").select("widget_id", "version_number", F.col("output_field_id").alias("field_id")).distinct().withColumn("is_key", F.lit("YES"))
    rel = inventory.all_details(repo).where("widget_type = 9").select("widget_id", "version_number").distinct()
    return rel.join(repo["opb_widget_field"], ["widget_id", "version_number"]).join(keyed, ["widget_id", "version_number", "field_id"], "left").select("widget_id", "field_id", F.coalesce("is_key", F.lit("NO")).alias("group_by"))


def d15a(spark, d):
    from pyspark.sql import Window

    repo = repository(spark, d)
    rel = blocks.relevant(inventory.all_details(repo).where("widget_type = 97"))
    inc = blocks.incoming(rel, repo["rep_mapping_conn_ports"])
    return inc.select("mapping_id", "instance_id", "field_name", "connected", F.dense_rank().over(Window.partitionBy("mapping_id", "instance_id").orderBy("object_name")).alias("group_no"))


def d16(spark, d):
    repo = repository(spark, d)
    rel = blocks.relevant(inventory.all_details(repo).where("widget_type = 6 OR upper(widget_type_name) LIKE '%STORED%PROC%'"))
    return blocks.attr_rows(rel, repo["rep_widget_attr"]).where("attr_name <> 'TRACING LEVEL'").select("instance_id", F.col("attr_name").alias("property"), F.col("attr_value").alias("value"))


QUERIES = {
    "f01_edges": f01, "f02_roles": f02, "f05_port_deps": f05, "f07_degrees": f07, "f08_reachable_from_targets": f08, "f09_trace_back": f09, "f11_stop_ports": f11, "f25_unresolved": f25, "f31_lineage_records": f31, "f33_completeness": f33, "f42_forward_paths": f42, "f42_path_forecast": f42_forecast, "f42_paths_by_target": f42_split, "f43_path_rows": f43,
    "f47_cross_session_links": f47, "g06_table_writers": g06, "g07_upstream_mapping": g07, "h02_type_counts": h02, "h03_mapping_summary": h03, "i01_paths_per_field": i01, "e03_transformation_order": e03, "e08_session_order": e08, "e09_reachable_tasks": e09, "e10_session_edges": e10,
    "e17_mapping_flow": e17, "e21_session_tables": e21, "e25_terminal_sessions": e25, "f39_select_items": f39, "g12_field_refs": g12, "g22_where_clause": g22, "g23_sql_tables": g23, "i12_table_aliases": i12, "d02b_condition_rows": d02b, "d05a_associated_sources": d05a,
    "d11a_normalizer_ports": d11a, "d11b_normalizer_columns": d11b, "d12a_router_groups": d12a, "d13b_group_by": d13b, "d15a_input_groups": d15a, "d16_stored_procedure": d16,
}

_EDGE = "edge AS (SELECT DISTINCT mapping_id, concat(from_object_instance_id, '.', from_object_field_name) AS src, concat(to_object_instance_id, '.', to_object_field_name) AS dst FROM rep_mapping_conn_ports)"
_PORT = """texts AS (SELECT e.widget_id, e.output_field_id AS field_id, string_agg(t.expression, chr(10) ORDER BY t.line_no) AS expression FROM opb_widget_expr e JOIN opb_expression t ON t.widget_id = e.widget_id AND t.expr_id = e.expr_id GROUP BY ALL),
prt AS MATERIALIZED (SELECT w.mapping_id, w.instance_id, w.instance_name, w.widget_type, w.widget_type_name, f.field_name, x.expression, concat(w.instance_id, '.', f.field_name) AS node FROM rep_widget_inst w JOIN opb_widget_field f ON f.widget_id = w.widget_id LEFT JOIN texts x ON x.widget_id = f.widget_id AND x.field_id = f.field_id)"""
_BARE = "regexp_replace(regexp_replace({x}, '--[^\\n]*', ' ', 'g'), '''[^'']*''', ' ', 'g')"
_STOPWORDS = "(" + ", ".join(f"'{f}'" for f in sqltext.FUNCTIONS) + ")"
_TOKENS = "list_filter(list_transform(regexp_extract_all(" + _BARE + ", '[A-Za-z_][A-Za-z0-9_$#]*'), lambda t: upper(t)), lambda t: t NOT IN " + _STOPWORDS + ")"
_DEPS = f"deps AS (SELECT DISTINCT a.mapping_id, a.node, b.node AS dep FROM (SELECT mapping_id, instance_id, node, unnest({_TOKENS.format(x='expression')}) AS token FROM prt WHERE expression IS NOT NULL) a JOIN prt b ON a.mapping_id = b.mapping_id AND a.instance_id = b.instance_id AND a.token = upper(b.field_name) AND a.node <> b.node)"
_PASS = "(trim(coalesce(expression, '')) = '' OR regexp_full_match(trim(expression), '[A-Za-z_][A-Za-z0-9_$#]*') OR upper(trim(expression)) = upper(field_name))"
_STOP = f"stopped AS (SELECT mapping_id, node FROM prt WHERE NOT {_PASS} AND widget_type NOT IN (97))"
_TGT = "tgt AS (SELECT DISTINCT p.mapping_id, p.node FROM prt p SEMI JOIN (SELECT mapping_id, dst AS node FROM edge) USING (mapping_id, node) WHERE widget_type = 2)"
_PARENTS = "parents AS MATERIALIZED (SELECT mapping_id, dst AS src, src AS dst FROM edge ANTI JOIN (SELECT mapping_id, node AS dst FROM stopped) USING (mapping_id, dst) UNION SELECT mapping_id, node, dep FROM deps)"
_REC = with_sql().replace("WITH ", "WITH RECURSIVE ", 1)
_G = f"{_REC},\n{_EDGE.replace('edge AS', 'edge AS MATERIALIZED')},\n{_PORT},\n{_DEPS},\n{_STOP},\n{_TGT},\n{_PARENTS}"
_TRACE = f"{_G},\ntrace AS (SELECT mapping_id, node AS start, node FROM tgt UNION SELECT t.mapping_id, t.start, p.dst FROM trace t JOIN parents p ON p.mapping_id = t.mapping_id AND p.src = t.node)"
_DEPTH = f"{_G},\ntraced AS (SELECT mapping_id, node AS start, node, 0 AS depth FROM tgt UNION SELECT t.mapping_id, t.start, p.dst, t.depth + 1 FROM traced t JOIN parents p ON p.mapping_id = t.mapping_id AND p.src = t.node WHERE t.depth < 60), trace AS MATERIALIZED (SELECT mapping_id, start, node, min(depth) AS depth FROM traced GROUP BY ALL)"
_ROLE = "CASE WHEN widget_type IN (1, 3) THEN 'source' WHEN widget_type = 2 THEN 'target' WHEN widget_type = 11 THEN 'lookup' WHEN widget_type IN (13, 15) THEN 'filter' ELSE 'transformation' END"
_REACH = "reach AS (SELECT mapping_id, node AS start, node FROM tgt UNION SELECT r.mapping_id, r.start, e.src FROM reach r JOIN edge e ON e.mapping_id = r.mapping_id AND e.dst = r.node)"
_RULE = "nullif(trim(regexp_replace(regexp_replace(arg_min(CASE WHEN is_rule THEN expression END, CASE WHEN is_rule THEN (depth, node) END), '--[^\\n]*', ' ', 'g'), '\\s+', ' ', 'g')), '\x00')"
_RECORDS = f"""{_DEPTH}, facts AS (SELECT t.*, p.instance_name, p.field_name, {_ROLE} AS role, p.widget_type_name, p.expression, NOT {_PASS} AS is_rule, EXISTS (SELECT 1 FROM parents q WHERE q.mapping_id = t.mapping_id AND q.src = t.node) AS goes_on FROM trace t JOIN prt p ON p.mapping_id = t.mapping_id AND p.node = t.node),
records AS (SELECT mapping_id, start, count(*) AS n_visited, coalesce(string_agg(DISTINCT CASE WHEN role = 'source' AND NOT goes_on THEN concat(instance_name, '.', field_name) END, ', ' ORDER BY CASE WHEN role = 'source' AND NOT goes_on THEN concat(instance_name, '.', field_name) END), '') AS sources,
string_agg(DISTINCT widget_type_name, ', ' ORDER BY widget_type_name) AS types, count(*) FILTER (role = 'lookup') AS n_lookups, {_RULE} AS primary_rule FROM facts GROUP BY mapping_id, start)"""
_PATHS = f"""{_G}, starts AS (SELECT DISTINCT mapping_id, src AS node FROM edge e WHERE NOT EXISTS (SELECT 1 FROM edge f WHERE f.mapping_id = e.mapping_id AND f.dst = e.src) OR EXISTS (SELECT 1 FROM prt p WHERE p.mapping_id = e.mapping_id AND p.node = e.src AND p.widget_type = 1)),
walk AS (SELECT mapping_id, [node] AS path, node AS at, false AS ended FROM starts UNION ALL SELECT w.mapping_id, list_append(w.path, e.dst), e.dst, t.node IS NOT NULL FROM walk w JOIN edge e ON e.mapping_id = w.mapping_id AND e.src = w.at LEFT JOIN tgt t ON t.mapping_id = e.mapping_id AND t.node = e.dst WHERE NOT w.ended AND NOT list_contains(w.path, e.dst)),
paths AS MATERIALIZED (SELECT mapping_id, path FROM walk WHERE ended)"""
_ORDER = f"""{_REC}, ie AS MATERIALIZED (SELECT DISTINCT mapping_id, from_object_name AS src, to_object_name AS dst FROM rep_mapping_conn_ports),
lay AS (SELECT mapping_id, instance_name AS node, 0 AS layer FROM rep_widget_inst UNION SELECT l.mapping_id, e.dst, l.layer + 1 FROM lay l JOIN ie e ON e.mapping_id = l.mapping_id AND e.src = l.node),
ordered AS (SELECT w.mapping_id, w.instance_name AS node, max(layer) AS layer, row_number() OVER (PARTITION BY w.mapping_id ORDER BY max(layer), w.instance_id) AS pos FROM rep_widget_inst w JOIN lay l ON l.mapping_id = w.mapping_id AND l.node = w.instance_name GROUP BY w.mapping_id, w.instance_name, w.instance_id)"""
_LINKS = f"""{_REC}, live AS (SELECT DISTINCT workflow_id, 'Start' AS task_name FROM workflow_link WHERE from_task = 'Start' UNION SELECT l.workflow_id, k.to_task FROM live l JOIN workflow_link k ON k.workflow_id = l.workflow_id AND k.from_task = l.task_name)"""
_SQLS = f"{with_sql('rep_widget_attr')}, q AS (SELECT widget_id, attr_id, attr_value AS sql FROM rep_widget_attr WHERE attr_value LIKE 'SELECT%')"
_DET = "AS (SELECT DISTINCT w.* FROM rep_widget_inst w JOIN rep_load_sessions s ON s.mapping_id = w.mapping_id JOIN rep_task_inst t ON t.task_id = s.session_id AND t.task_type = 68)"
_D = f"{with_sql()}, det {_DET}"
_NORM = f"{_D}, np AS (SELECT w.instance_id, f.*, regexp_replace(field_name, '(?i)_in[0-9]*$', '') AS column_name, CASE WHEN regexp_matches(field_name, '(?i)_in[0-9]*$') THEN 'INPUT_OCCURRENCE' WHEN upper(field_name) LIKE 'GK_%' THEN 'GENERATED_KEY' WHEN upper(field_name) LIKE 'GCID_%' THEN 'GENERATED_COLUMN_ID' ELSE 'OUTPUT' END AS category FROM det w JOIN opb_widget_field f ON f.widget_id = w.widget_id WHERE w.widget_type = 14)"

ORACLE = {
    "f01_edges": f"{with_sql()}, {_EDGE} SELECT * FROM edge",
    "f02_roles": f"{with_sql()} SELECT mapping_id, instance_id, {_ROLE} AS role FROM rep_widget_inst",
    "f05_port_deps": f"{_G} SELECT mapping_id, node, dep FROM deps",
    "f07_degrees": f"{with_sql()}, {_EDGE} SELECT mapping_id, node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT mapping_id, src AS node, 0 AS i, 1 AS o FROM edge UNION ALL SELECT mapping_id, dst, 1, 0 FROM edge) GROUP BY 1, 2",
    "f08_reachable_from_targets": f"{_G}, {_REACH} SELECT * FROM reach",
    "f09_trace_back": f"{_TRACE} SELECT mapping_id, start, node FROM trace",
    "f11_stop_ports": f"{_G} SELECT mapping_id, node FROM stopped",
    "f25_unresolved": f"{_TRACE} SELECT DISTINCT p.mapping_id, p.instance_name, p.field_name FROM trace t JOIN prt p ON p.mapping_id = t.mapping_id AND p.node = t.node WHERE {_ROLE} <> 'source' AND NOT EXISTS (SELECT 1 FROM parents q WHERE q.mapping_id = t.mapping_id AND q.src = t.node)",
    "f31_lineage_records": f"{_RECORDS} SELECT * FROM records",
    "f33_completeness": f"{_RECORDS}, {_REACH}, e AS (SELECT mapping_id, count(DISTINCT node) AS expected_fields FROM prt WHERE widget_type = 2 GROUP BY 1), a AS (SELECT mapping_id, count(*) AS actual_fields, count(*) FILTER (sources = '') AS without_source FROM records GROUP BY 1), r AS (SELECT mapping_id, count(DISTINCT node) AS reachable_ports FROM reach GROUP BY 1) SELECT e.mapping_id, expected_fields, coalesce(actual_fields, 0) AS actual_fields, coalesce(without_source, 0) AS without_source, coalesce(reachable_ports, 0) AS reachable_ports, expected_fields = coalesce(actual_fields, 0) AND coalesce(without_source, 0) = 0 AS is_complete FROM e LEFT JOIN a USING (mapping_id) LEFT JOIN r USING (mapping_id)",
    "h02_type_counts": f"{_RECORDS} SELECT type, count(*) AS n FROM (SELECT unnest(string_split(types, ', ')) AS type FROM records) GROUP BY 1",
    "h03_mapping_summary": f"{_RECORDS} SELECT mapping_id, count(*) AS fields, count(primary_rule) AS with_rule, count(*) FILTER (n_lookups > 0) AS with_lookup FROM records GROUP BY 1",
    "f42_path_forecast": f"{_PATHS} SELECT mapping_id, path[-1] AS target, CAST(count(*) AS DOUBLE) AS n_paths, CAST(max(len(path)) AS INTEGER) AS longest, false AS looped, count(*) > 3 AS explodes FROM paths GROUP BY 1, 2",
    "f42_paths_by_target": f"{_PATHS} SELECT mapping_id, array_to_string(path, ' -> ') AS path FROM paths",
    "f42_forward_paths": f"{_PATHS} SELECT mapping_id, array_to_string(path, ' -> ') AS path FROM paths",
    "f43_path_rows": f"{_PATHS}, x AS (SELECT mapping_id, path, len(path) - 1 AS hops, unnest(path) AS node, unnest(range(len(path))) AS pos FROM paths), y AS (SELECT x.*, p.instance_name, p.widget_type_name, p.field_name, pos > 0 AND pos < hops AND widget_type NOT IN (1, 2) AS inn FROM x JOIN prt p ON p.mapping_id = x.mapping_id AND p.node = x.node), z AS (SELECT *, bool_or(inn) OVER (PARTITION BY mapping_id, path) AS has_inner FROM y) SELECT mapping_id, array_to_string(path, ' -> ') AS full_path, path[1] AS source, path[-1] AS target, hops, instance_name AS transformation, widget_type_name AS transformation_type, field_name FROM z WHERE inn OR (NOT has_inner AND pos = 0)",
    "i01_paths_per_field": f"{_PATHS}, s AS (SELECT DISTINCT mapping_id, path[-1] AS target, array_to_string(list_transform(path, lambda p: string_split(p, '.')[1]), ' -> ') AS seq FROM paths), n AS (SELECT *, row_number() OVER (PARTITION BY mapping_id, target ORDER BY seq) AS k FROM s) SELECT mapping_id, target, count(*) AS n_paths, string_agg(concat('Path', k, ': ', seq), '; ' ORDER BY k) AS paths FROM n GROUP BY 1, 2",
    "f47_cross_session_links": f"{with_sql()}, tf AS (SELECT DISTINCT t.table_name, f.field_name, t.mapping_id, t.widget_type FROM inst_table t JOIN opb_widget_field f ON f.widget_id = t.instance_id) SELECT r.mapping_id AS reader, r.table_name, r.field_name, count(*) AS n_links, string_agg(concat('m_', w.mapping_id, '.', r.table_name, '.', r.field_name), chr(10) ORDER BY w.mapping_id) AS links FROM tf r JOIN tf w ON r.table_name = w.table_name AND r.field_name = w.field_name AND r.widget_type = 1 AND w.widget_type = 2 AND w.mapping_id < r.mapping_id GROUP BY 1, 2, 3",
    "g06_table_writers": f"{with_sql()} SELECT DISTINCT table_name, mapping_id AS writer FROM inst_table WHERE widget_type = 2",
    "g07_upstream_mapping": f"{with_sql()}, b AS (SELECT DISTINCT r.mapping_id AS reader, r.table_name, w.mapping_id AS writer FROM inst_table r JOIN inst_table w ON r.table_name = w.table_name AND r.widget_type = 1 AND w.widget_type = 2 AND r.mapping_id <> w.mapping_id) SELECT reader, table_name, count(*) AS n_writers, coalesce(max(writer) FILTER (writer < reader), max(writer)) AS upstream, max(writer) FILTER (writer < reader) IS NULL AND count(*) > 1 AS ambiguous FROM b GROUP BY 1, 2",
    "e03_transformation_order": f"{_ORDER} SELECT mapping_id, node, layer, pos FROM ordered",
    "e17_mapping_flow": f"{_ORDER} SELECT mapping_id, string_agg(node, ' -> ' ORDER BY pos) AS flow FROM ordered GROUP BY 1",
    "e08_session_order": f"{_LINKS}, kept AS (SELECT k.* FROM workflow_link k SEMI JOIN (SELECT workflow_id, task_name AS from_task FROM live) USING (workflow_id, from_task)), lay AS (SELECT workflow_id, 'Start' AS node, 0 AS layer FROM live UNION SELECT l.workflow_id, k.to_task, l.layer + 1 FROM lay l JOIN kept k ON k.workflow_id = l.workflow_id AND k.from_task = l.node), top AS (SELECT workflow_id, node, max(layer) AS layer FROM lay GROUP BY 1, 2), fed AS (SELECT workflow_id, to_task AS node, string_agg(from_task, ', ' ORDER BY from_task) AS predecessors, string_agg(coalesce(condition, '[condition: none defined]'), ' | ' ORDER BY from_task) AS conditions FROM kept GROUP BY 1, 2) SELECT t.workflow_id, t.session_name, top.layer, predecessors, conditions FROM task t JOIN top ON top.workflow_id = t.workflow_id AND top.node = t.task_name LEFT JOIN fed ON fed.workflow_id = t.workflow_id AND fed.node = t.task_name WHERE t.session_name IS NOT NULL",
    "e09_reachable_tasks": f"{_LINKS} SELECT workflow_id, task_name FROM live UNION ALL SELECT DISTINCT workflow_id, task_name FROM (SELECT workflow_id, unnest([from_task, to_task]) AS task_name FROM workflow_link) WHERE workflow_id NOT IN (SELECT workflow_id FROM live)",
    "e10_session_edges": f"{with_sql()} SELECT k.workflow_id, k.from_task, t.session_name AS to_session, coalesce(condition, '[condition: none defined]') AS condition FROM workflow_link k JOIN task t ON t.workflow_id = k.workflow_id AND t.task_name = k.to_task WHERE t.session_name IS NOT NULL",
    "e21_session_tables": f"{with_sql()} SELECT mapping_id, sources, targets, concat(sources, ' -> ', targets) AS flow FROM (SELECT mapping_id, coalesce(string_agg(DISTINCT CASE WHEN widget_type = 1 THEN table_name END, ', ' ORDER BY CASE WHEN widget_type = 1 THEN table_name END), '') AS sources, coalesce(string_agg(DISTINCT CASE WHEN widget_type = 2 THEN table_name END, ', ' ORDER BY CASE WHEN widget_type = 2 THEN table_name END), '') AS targets FROM inst_table GROUP BY 1)",
    "e25_terminal_sessions": f"{with_sql()} SELECT workflow_id, session_name FROM task t WHERE session_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM workflow_link k WHERE k.workflow_id = t.workflow_id AND k.from_task = t.task_name)",
    "f39_select_items": f"{_SQLS}, i AS (SELECT widget_id, attr_id, unnest(string_split(regexp_extract(sql, 'SELECT (.*) FROM', 1), ',')) AS item, unnest(range(2)) AS pos FROM q) SELECT widget_id, attr_id, pos, trim(item) AS item, CASE WHEN contains(item, ' AS ') THEN regexp_extract(item, ' AS (\\w+)', 1) ELSE regexp_extract(item, '\\.(\\w+)$', 1) END AS alias FROM i",
    "g12_field_refs": f"{with_sql('opb_expression')} SELECT widget_id, expr_id, line_no, coalesce(array_to_string({_TOKENS.format(x='expression')}, ','), '') AS tokens FROM opb_expression",
    "g22_where_clause": f"{_SQLS} SELECT widget_id, attr_id, regexp_extract(sql, 'WHERE (.*) ORDER BY', 1) AS where_text FROM q",
    "g23_sql_tables": f"{_SQLS}, t AS (SELECT widget_id, attr_id, regexp_extract(sql, 'FROM (\\w+)', 1) AS a, regexp_extract(sql, 'JOIN OWN\\.(\\w+)', 1) AS b FROM q) SELECT widget_id, attr_id, CASE WHEN a = b THEN a ELSE concat(a, ',', b) END AS tables FROM t",
    "i12_table_aliases": f"{_SQLS} SELECT widget_id, attr_id, concat(regexp_extract(sql, 'FROM (\\w+ A)', 1), ',', regexp_extract(sql, 'JOIN (OWN\\.\\w+ B)', 1)) AS aliases FROM q",
    "d02b_condition_rows": f"""{with_sql('rep_widget_attr')}, n AS (SELECT widget_id, string_split(regexp_replace(replace(attr_value, ';', ' AND '), '(?i)\\s+AND\\s+', chr(1), 'g'), chr(1)) AS parts FROM rep_widget_attr WHERE upper(attr_name) = 'LOOKUP CONDITION' AND trim(attr_value) <> ''), c AS (SELECT widget_id, trim(unnest(parts)) AS condition, unnest(range(1, len(parts) + 1)) AS condition_order FROM n)
SELECT widget_id, CAST(condition_order AS INTEGER) AS condition_order, condition, CASE WHEN o <> '' THEN trim(regexp_extract(condition, '^(.*?)\\s*(<>|!=|<=|>=|=|<|>)', 1)) END AS lookup_column, CASE WHEN o <> '' THEN o END AS operator, CASE WHEN o <> '' THEN trim(regexp_replace(condition, '^.*?(<>|!=|<=|>=|=|<|>)', '')) END AS port FROM (SELECT *, regexp_extract(condition, '<>|!=|<=|>=|=|<|>') AS o FROM c)""",
    "d05a_associated_sources": f"{_D} SELECT mapping_id, instance_id, string_agg(name, ', ' ORDER BY name) AS associated_sources FROM (SELECT DISTINCT c.mapping_id, c.to_object_instance_id AS instance_id, c.from_object_name AS name FROM rep_mapping_conn_ports c JOIN det w ON w.instance_id = c.to_object_instance_id WHERE w.widget_type = 3) GROUP BY 1, 2",
    "d11a_normalizer_ports": f"{_NORM} SELECT instance_id, field_name, column_name, category FROM np",
    "d11b_normalizer_columns": f"{_NORM} SELECT instance_id, column_name, min(field_order) FILTER (category = 'INPUT_OCCURRENCE') AS first_order, CASE WHEN count(*) FILTER (category = 'INPUT_OCCURRENCE') > 1 THEN count(*) FILTER (category = 'INPUT_OCCURRENCE') ELSE 0 END AS occurs, max(wgt_datatype) FILTER (category = 'OUTPUT') AS datatype_code, max(wgt_prec) FILTER (category = 'OUTPUT') AS prec FROM np WHERE category IN ('INPUT_OCCURRENCE', 'OUTPUT') GROUP BY 1, 2",
    "d12a_router_groups": f"{with_sql()} SELECT object_id, version_number, group_id, max(CASE WHEN attr_id = 1 THEN trim(attr_value) END) AS group_name, max(CASE WHEN attr_id = 3 THEN trim(attr_value) END) AS group_condition FROM opb_table_group WHERE object_type = 15 GROUP BY 1, 2, 3",
    "d13b_group_by": f"{_D} SELECT f.widget_id, f.field_id, CASE WHEN EXISTS (SELECT 1 FROM opb_widget_expr e WHERE e.widget_id = f.widget_id AND e.output_field_id = f.field_id AND e.expr_type = 46) THEN 'YES' ELSE 'NO' END AS group_by FROM det w JOIN opb_widget_field f ON f.widget_id = w.widget_id WHERE w.widget_type = 9",
    "d15a_input_groups": f"{_D} SELECT DISTINCT c.mapping_id, c.to_object_instance_id AS instance_id, c.to_object_field_name AS field_name, concat(c.from_object_name, '.', c.from_object_field_name) AS connected, CAST(dense_rank() OVER (PARTITION BY c.mapping_id, c.to_object_instance_id ORDER BY c.from_object_name) AS INTEGER) AS group_no FROM rep_mapping_conn_ports c JOIN det w ON w.instance_id = c.to_object_instance_id WHERE w.widget_type = 97",
    "d16_stored_procedure": f"{_D} SELECT w.instance_id, upper(trim(attr_name)) AS property, nullif(trim(attr_value), '') AS value FROM det w JOIN rep_widget_attr a ON a.widget_id = w.widget_id AND (a.instance_id IS NULL OR a.instance_id = 0 OR a.instance_id = w.instance_id) WHERE w.widget_type = 6 AND upper(trim(attr_name)) <> 'TRACING LEVEL'",
}
