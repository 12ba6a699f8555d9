"""Queries of the typed edges and the backward tracer over the export tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.operators import graph, overview
from metaloom.operators import typed_edges as T
from metaloom.sources.fixture import repository, with_sql
from metaloom.sources.store import cut


def _tables(spark, d) -> tuple[DataFrame, ...]:
    repo = repository(spark, d)
    return repo["x_inst"], repo["x_port"], repo["x_attr"], repo["x_conn"]


def _trace(spark, d):
    inst, port, attr, conn = _tables(spark, d)
    parent = cut(T.parents(port, attr, conn), "parents")
    return inst, port, attr, conn, parent, T.traced(T.target_starts(port, conn), parent)


def _parents(spark, d):
    """What the walks of other starts need: no trace of the targets is made."""
    _, port, attr, conn = _tables(spark, d)
    return port, attr, cut(T.parents(port, attr, conn), "parents")


def f04(spark, d):
    """Attributes of instances, and of definitions by their last instance in document order."""
    inst, _, attr, _ = _tables(spark, d)
    return overview.effective_attributes(attr, inst)


def f05(spark, d):
    return T.dependencies(_tables(spark, d)[1])


def f06(spark, d):
    return _tables(spark, d)[1].where("expression is not null and trim(expression) <> ''").select("mapping_id", "instance", F.col("field").alias("port"), "expression")


def f09(spark, d):
    return _trace(spark, d)[5].select("mapping_id", "start", "node")


def f12(spark, d):
    return T.opaque_edges(_tables(spark, d)[1])


def f13(spark, d):
    return T.generated_ports(_tables(spark, d)[1])


def f14(spark, d):
    return T.return_ports(_tables(spark, d)[1])


def f15(spark, d):
    return T.lookup_pairs(_tables(spark, d)[2])


def f16(spark, d):
    _, port, attr, _ = _tables(spark, d)
    return T.lookup_edges(attr, port)


def f17(spark, d):
    return T.unconnected_lookups(_tables(spark, d)[1])


def f18(spark, d):
    _, port, attr, _ = _tables(spark, d)
    return T.bind_edges(attr, port)


def f19(spark, d):
    return T.base_instances(_tables(spark, d)[0])


def f20(spark, d):
    _, port, _, conn = _tables(spark, d)
    return T.union_edges(port, conn)


def f21(spark, d):
    _, port, _, conn = _tables(spark, d)
    return T.resolved_ports(conn, port)


def f22(spark, d):
    _, port, attr, _, _, trace = _trace(spark, d)
    return T.lookups_used(trace, port, attr)


def f24(spark, d):
    _, port, attr, _, _, trace = _trace(spark, d)
    return T.conditions_used(trace, port, attr)


def f25(spark, d):
    inst, port, _, _, parent, trace = _trace(spark, d)
    return T.unresolved(trace, parent, port, inst)


def f26(spark, d):
    inst, port, attr, _, parent, trace = _trace(spark, d)
    return T.diagnostics(T.unresolved(trace, parent, port, inst), T.unknown_pairs(attr, port))


def f27(spark, d):
    return T.final_targets(_tables(spark, d)[0])


def f28(spark, d):
    inst, _, _, conn = _tables(spark, d)
    return T.select_targets(inst, conn, repository(spark, d)["x_load_order"])


def f29(spark, d):
    """Mappings in scope: those that terminal sessions run."""
    repo = repository(spark, d)
    return overview.terminal_mappings(repo["x_task"], repo["x_link"], repo["x_session"]).select("mapping_name").distinct()


def f30(spark, d):
    inst, _, _, conn = _tables(spark, d)
    return T.target_fields(inst, repository(spark, d)["x_target_field"], conn)


def f32(spark, d):
    _, _, _, _, _, trace = _trace(spark, d)
    return T.missing_fields(f30(spark, d), trace)


def f35(spark, d):
    """Lookup derivations, each driving field with the sources of its own trace."""
    port, attr, parent = _parents(spark, d)
    rows = T.lookup_derivations(attr, port)
    starts = rows.where("is_traced").select("mapping_id", T.node("instance", "driving_field").alias("start")).distinct()
    found = T.sources_of(T.traced(starts, parent), parent, port)
    return rows.withColumn("start", F.when(F.col("is_traced"), T.node("instance", "driving_field"))).join(found, ["mapping_id", "start"], "left").select("mapping_id", "instance", "lookup_field", "driving_field", "n_visited", "sources")


def f36(spark, d):
    """Fields of condition and query attributes with the sources of their traces."""
    port, attr, parent = _parents(spark, d)
    rows = T.condition_fields(attr, port).withColumn("start", T.node())
    found = T.sources_of(T.traced(rows.select("mapping_id", "start").distinct(), parent), parent, port)
    return rows.join(found, ["mapping_id", "start"]).select("mapping_id", "instance", "name", "field", "n_visited", "sources")


def f37(spark, d):
    """Fields tied to those that the traces touch, inside their transformations."""
    _, port, attr, _, _, trace = _trace(spark, d)
    touched = trace.select("mapping_id", "node").distinct()  # a port once, not for each start
    seeds = touched.join(T.facts(port).where(T.transforms()), ["mapping_id", "node"]).select("mapping_id", F.col("instance").alias("start"), "node")
    ties = T.co_references(attr, port).select("mapping_id", F.col("node").alias("src"), F.col("parent").alias("dst"))
    return graph.spread(seeds, ties, ["mapping_id", "start"]).select("mapping_id", F.col("start").alias("instance"), "node")


def f38(spark, d):
    """Fields that the rules name with the sources of their traces."""
    port, _, parent = _parents(spark, d)
    rows = T.expression_fields(port).withColumn("start", T.node())
    found = T.sources_of(T.traced(rows.select("mapping_id", "start").distinct(), parent), parent, port)
    return rows.join(found, ["mapping_id", "start"]).select("mapping_id", "instance", "rule_field", "expression", "field", "n_visited", "sources")


QUERIES = {
    "f04_effective_attributes": f04, "f05_all_dependencies": f05, "f06_expression_map": f06, "f09_typed_trace": f09, "f12_opaque_edges": f12, "f13_generated_ports": f13, "f14_return_ports": f14, "f15_lookup_pairs": f15, "f16_lookup_edges": f16,
    "f17_unconnected_lookups": f17, "f18_bind_edges": f18, "f19_base_instances": f19, "f20_union_edges": f20, "f21_resolved_ports": f21, "f22_lookups_used": f22, "f24_conditions_used": f24, "f25_unresolved_reasons": f25,
    "f26_diagnostics": f26, "f27_final_targets": f27, "f28_select_targets": f28, "f29_scope_mappings": f29, "f30_target_fields": f30, "f32_missing_fields": f32, "f35_lookup_derivations": f35, "f36_condition_derivations": f36, "f37_involved_fields": f37, "f38_expression_breakdown": f38,
}

_N = "[A-Za-z_][A-Za-z0-9_$#]*"
_ND = "[A-Za-z_][A-Za-z0-9_$#.]*"
_TX = "type NOT IN ('Source Definition', 'Target Definition')"
_UNION = "(upper(type) LIKE '%UNION%' OR (upper(type) LIKE '%CUSTOM%' AND upper(coalesce(template, '')) LIKE '%UNION%'))"
_OPAQUE = "(upper(type) LIKE '%JAVA%' OR upper(type) LIKE '%SQL%' OR upper(type) LIKE '%CUSTOM%' OR upper(type) LIKE '%EXTERNAL%')"
_PASS = f"(trim(coalesce(expression, '')) = '' OR regexp_full_match(trim(coalesce(expression, '')), '{_N}') OR upper(trim(expression)) = upper(field))"
_SIDE = "regexp_extract(list_last(regexp_extract_all(regexp_extract(part, '^\\s*(.+?)\\s*=\\s*(.+)$', {i}), '" + _ND + "')), '[^.]*$')"
_WORDS = " OR ".join(f"lower(name) LIKE '%{w}%'" for w in ("condition", "filter", "sql", "query", "override", "join", "where", "having"))


def base() -> str:
    sql = with_sql().replace("WITH ", "WITH RECURSIVE ", 1)
    for name in ("x_inst", "x_port", "x_attr", "x_conn"):
        sql = sql.replace(f"\n{name} AS (", f"\n{name} AS MATERIALIZED (")
    return f"""{sql},
up AS MATERIALIZED (SELECT mapping_id, instance, upper(field) AS u, field FROM x_port),
raw AS (SELECT p.mapping_id, p.instance || '.' || p.field AS node, c.from_inst, c.from_field FROM x_port p JOIN x_conn c ON c.mapping_id = p.mapping_id AND c.to_field = p.field AND c.to_inst = CASE WHEN upper(p.type) LIKE '%ROUTER%' OR upper(p.type) LIKE '%JOINER%' THEN split_part(p.instance, '.', 1) ELSE p.instance END WHERE NOT {_UNION}),
raw_union AS (SELECT p.mapping_id, p.instance || '.' || p.field AS node, c.from_inst, c.from_field FROM x_port p JOIN x_conn c ON c.mapping_id = p.mapping_id AND upper(c.to_field) = upper(p.field) WHERE {_UNION} AND (c.to_inst = p.instance OR starts_with(c.to_inst, p.instance || '.'))),
union_edge AS (SELECT DISTINCT r.mapping_id, node, from_inst || '.' || coalesce(up.field, from_field) AS parent FROM raw_union r LEFT JOIN up ON up.mapping_id = r.mapping_id AND up.instance = r.from_inst AND up.u = upper(from_field)),
conn_edge AS (SELECT DISTINCT r.mapping_id, node, from_inst || '.' || coalesce(up.field, from_field) AS parent FROM raw r LEFT JOIN up ON up.mapping_id = r.mapping_id AND up.instance = r.from_inst AND up.u = upper(from_field) UNION SELECT * FROM union_edge),
dep_edge AS (SELECT DISTINCT p.mapping_id, p.instance || '.' || p.field AS node, p.instance || '.' || up.field AS parent FROM (SELECT *, unnest(regexp_extract_all(expression, '{_N}')) AS tok FROM x_port WHERE expression IS NOT NULL AND {_TX}) p JOIN up ON up.mapping_id = p.mapping_id AND up.instance = p.instance AND up.u = upper(tok) WHERE up.field <> p.field),
opaque_edge AS (SELECT p.mapping_id, p.instance || '.' || p.field AS node, p.instance || '.' || up.field AS parent FROM x_port p JOIN up ON up.mapping_id = p.mapping_id AND up.instance = p.instance AND up.u = upper(regexp_extract(p.expression, '^\\s*({_N})\\s*=\\s*({_N})\\s*$', 2)) WHERE {_OPAQUE} AND regexp_matches(p.expression, '^\\s*{_N}\\s*=\\s*{_N}\\s*$') AND upper(regexp_extract(p.expression, '^\\s*({_N})\\s*=', 1)) = upper(p.field)),
pairs AS MATERIALIZED (SELECT mapping_id, instance, min("left") AS "left", min("right") AS "right" FROM (SELECT mapping_id, instance, {_SIDE.format(i=1)} AS "left", {_SIDE.format(i=2)} AS "right" FROM (SELECT mapping_id, instance, unnest(regexp_split_to_array(value, '(?i)\\bAND\\b|\\bOR\\b')) AS part FROM x_attr WHERE upper(type) LIKE '%LOOKUP%' AND lower(name) = 'lookup condition') WHERE part LIKE '%=%') WHERE "left" IS NOT NULL AND "right" IS NOT NULL GROUP BY mapping_id, instance, upper("left"), upper("right")),
paired AS (SELECT p.mapping_id, p.instance, a.field AS a, b.field AS b, p."left", p."right" FROM pairs p JOIN up a ON a.mapping_id = p.mapping_id AND a.instance = p.instance AND a.u = upper("left") JOIN up b ON b.mapping_id = p.mapping_id AND b.instance = p.instance AND b.u = upper("right")),
lookup_edge AS (SELECT mapping_id, instance || '.' || a AS node, instance || '.' || b AS parent FROM paired WHERE a <> b UNION SELECT mapping_id, instance || '.' || b, instance || '.' || a FROM paired WHERE a <> b),
bind_edge AS (SELECT DISTINCT p.mapping_id, p.instance || '.' || p.field AS node, p.instance || '.' || up.field AS parent FROM x_port p JOIN (SELECT mapping_id, instance, unnest(regexp_extract_all(value, ':({_N.replace("$#", "")})', 1)) AS v FROM x_attr WHERE upper(type) LIKE '%SQL%' AND name = 'Sql Query') q ON q.mapping_id = p.mapping_id AND q.instance = p.instance JOIN up ON up.mapping_id = p.mapping_id AND up.instance = p.instance AND up.u = upper(v) WHERE up.field <> p.field),
made AS (SELECT mapping_id, instance || '.' || field AS node, '[GENERATED: ' || type || ']' AS expression FROM x_port WHERE {_TX} AND ((field = 'RANKINDEX' AND upper(type) LIKE '%RANK%') OR (field = 'TCONTROL' AND upper(type) LIKE '%TRANSACTION CONTROL%') OR (starts_with(field, 'DD_') AND upper(type) LIKE '%UPDATE STRATEGY%') OR ((starts_with(field, 'GK_') OR starts_with(field, 'GCID_')) AND upper(type) LIKE '%NORMALIZER%'))),
returned AS (SELECT mapping_id, instance || '.' || field AS node, '[RETURN: lookup result]' AS expression FROM x_port WHERE upper(porttype) = 'RETURN' AND upper(type) LIKE '%LOOKUP%'),
stop AS (SELECT mapping_id, instance || '.' || field AS node FROM x_port WHERE {_TX} AND NOT {_PASS} AND NOT {_OPAQUE}),
parent AS MATERIALIZED (SELECT * FROM (SELECT * FROM conn_edge ANTI JOIN stop USING (mapping_id, node) UNION SELECT * FROM dep_edge UNION SELECT * FROM lookup_edge UNION SELECT * FROM bind_edge UNION SELECT * FROM opaque_edge) ANTI JOIN (SELECT mapping_id, node FROM made UNION SELECT mapping_id, node FROM returned) USING (mapping_id, node)),
fact AS (SELECT mapping_id, instance || '.' || field AS node, instance, field, type, porttype, expression FROM x_port),
start AS (SELECT DISTINCT p.mapping_id, p.instance || '.' || p.field AS start FROM x_port p JOIN x_conn c ON c.mapping_id = p.mapping_id AND c.to_inst = p.instance AND c.to_field = p.field WHERE p.type = 'Target Definition'),
walk AS (SELECT mapping_id, start, start AS node FROM start UNION SELECT w.mapping_id, w.start, p.parent FROM walk w JOIN parent p ON p.mapping_id = w.mapping_id AND p.node = w.node),
leaf AS (SELECT mapping_id, node FROM fact WHERE type IN ('Source Definition', 'Source Qualifier') AND NOT EXISTS (SELECT 1 FROM parent p WHERE p.mapping_id = fact.mapping_id AND p.node = fact.node)),
open_port AS (SELECT w.mapping_id, w.node, CASE WHEN EXISTS (SELECT 1 FROM x_inst i WHERE i.mapping_id = w.mapping_id AND i.instance = regexp_replace(w.node, '\\.[^.]*$', '')) THEN 'port_not_in_transformation' ELSE 'unknown_instance' END AS reason FROM (SELECT DISTINCT mapping_id, node FROM walk) w ANTI JOIN fact USING (mapping_id, node)
  UNION ALL SELECT DISTINCT f.mapping_id, f.node, 'no_incoming_connector' FROM fact f JOIN walk w ON w.mapping_id = f.mapping_id AND w.node = f.node WHERE {_TX} AND type <> 'Source Qualifier' AND NOT EXISTS (SELECT 1 FROM (SELECT mapping_id, node FROM parent UNION ALL SELECT mapping_id, node FROM made UNION ALL SELECT mapping_id, node FROM returned UNION ALL SELECT mapping_id, node FROM stop) e WHERE e.mapping_id = f.mapping_id AND e.node = f.node)),
final AS (SELECT DISTINCT subject_id, upper(definition) AS definition FROM x_inst WHERE type = 'Target Definition' EXCEPT SELECT subject_id, upper(definition) FROM x_inst WHERE type = 'Source Definition'),
wanted AS (SELECT t.mapping_id, t.instance, f.field, 'definition' AS known_by FROM x_inst t JOIN x_target_field f ON f.definition = t.definition WHERE t.type = 'Target Definition' UNION ALL SELECT DISTINCT t.mapping_id, t.instance, c.to_field, 'connector' FROM x_inst t JOIN x_conn c ON c.mapping_id = t.mapping_id AND c.to_inst = t.instance WHERE t.type = 'Target Definition' AND t.definition NOT IN (SELECT definition FROM x_target_field)),
cond_field AS (SELECT DISTINCT a.mapping_id, a.instance, a.name, up.field FROM (SELECT mapping_id, instance, name, unnest(regexp_extract_all(value, '{_ND}')) AS tok FROM x_attr WHERE {_TX} AND ({_WORDS})) a JOIN up ON up.mapping_id = a.mapping_id AND up.instance = a.instance AND up.u = upper(regexp_extract(tok, '[^.]*$')))"""


def _traced(starts: str) -> str:
    """Sources of the traces of other starts (mapping_id, start)."""
    return f"""own_start AS (SELECT DISTINCT mapping_id, start FROM ({starts}) WHERE start IS NOT NULL),
own_walk AS (SELECT mapping_id, start, start AS node FROM own_start UNION SELECT w.mapping_id, w.start, p.parent FROM own_walk w JOIN parent p ON p.mapping_id = w.mapping_id AND p.node = w.node),
found AS (SELECT w.mapping_id, w.start, count(*) AS n_visited, coalesce(string_agg(l.node, ', ' ORDER BY l.node), '') AS sources FROM own_walk w LEFT JOIN leaf l ON l.mapping_id = w.mapping_id AND l.node = w.node GROUP BY 1, 2)"""


_DERIVED = """drv AS (SELECT p.mapping_id, p.instance, CASE WHEN y.is_lookup AND NOT x.is_lookup THEN b ELSE a END AS lookup_field, CASE WHEN y.is_lookup AND NOT x.is_lookup THEN a ELSE b END AS driving_field, x.is_lookup <> y.is_lookup AS is_traced FROM paired p JOIN kinds x ON x.mapping_id = p.mapping_id AND x.instance = p.instance AND x.field = a JOIN kinds y ON y.mapping_id = p.mapping_id AND y.instance = p.instance AND y.field = b)"""
_B = base()

ORACLE = {
    "f04_effective_attributes": f"{_B} SELECT mapping_id, owner, name, max_by(value, rank) AS value FROM (SELECT a.mapping_id, i.instance AS owner, a.name, a.value, 1000000 AS rank FROM x_attr a JOIN x_inst i ON i.mapping_id = a.mapping_id AND i.instance = a.instance UNION ALL SELECT a.mapping_id, i.definition, a.name, a.value, i.ord FROM x_attr a JOIN x_inst i ON i.mapping_id = a.mapping_id AND i.instance = a.instance WHERE i.definition <> i.instance) GROUP BY 1, 2, 3",
    "f05_all_dependencies": f"{_B} SELECT * FROM dep_edge",
    "f06_expression_map": f"{_B} SELECT mapping_id, instance, field AS port, expression FROM x_port WHERE trim(coalesce(expression, '')) <> ''",
    "f09_typed_trace": f"{_B} SELECT mapping_id, start, node FROM walk",
    "f12_opaque_edges": f"{_B} SELECT * FROM opaque_edge",
    "f13_generated_ports": f"{_B} SELECT * FROM made",
    "f14_return_ports": f"{_B} SELECT * FROM returned",
    "f15_lookup_pairs": f'{_B} SELECT mapping_id, instance, "left", "right" FROM pairs',
    "f16_lookup_edges": f"{_B} SELECT * FROM lookup_edge",
    "f17_unconnected_lookups": f"{_B} SELECT DISTINCT mapping_id, instance, field, regexp_extract(c, '(?i)LKP\\s*:\\s*(\\w+)', 1) AS lookup, regexp_extract(c, '\\(\\s*(\\w+)', 1) AS given FROM (SELECT mapping_id, instance, field, unnest(regexp_extract_all(expression, '(?i)LKP\\s*:\\s*[A-Za-z_][A-Za-z0-9_]*\\s*\\(\\s*[A-Za-z_][A-Za-z0-9_]*\\s*\\)')) AS c FROM x_port)",
    "f18_bind_edges": f"{_B} SELECT * FROM bind_edge",
    "f19_base_instances": f"{_B} SELECT mapping_id, instance, split_part(instance, '.', 1) AS base FROM x_inst WHERE type IN ('Router', 'Joiner') AND instance LIKE '%.%'",
    "f20_union_edges": f"{_B} SELECT * FROM union_edge",
    "f21_resolved_ports": f"{_B} SELECT DISTINCT c.mapping_id, c.instance, c.given, up.field FROM (SELECT mapping_id, from_inst AS instance, from_field AS given FROM x_conn UNION SELECT mapping_id, to_inst, to_field FROM x_conn) c JOIN up ON up.mapping_id = c.mapping_id AND up.instance = c.instance AND up.u = upper(c.given) WHERE up.field <> c.given",
    "f22_lookups_used": f"{_B}, a AS (SELECT mapping_id, instance, max(CASE WHEN lower(name) = 'lookup table name' THEN value END) AS lookup_table, max(CASE WHEN lower(name) = 'lookup condition' THEN value END) AS lookup_condition, max(CASE WHEN lower(name) = 'lookup sql override' THEN value END) AS lookup_sql_override, max(CASE WHEN lower(name) = 'lookup source filter' THEN value END) AS lookup_source_filter FROM x_attr GROUP BY 1, 2) SELECT m.mapping_id, m.start, m.instance, lookup_table, lookup_condition, lookup_sql_override, lookup_source_filter FROM (SELECT DISTINCT w.mapping_id, w.start, f.instance FROM walk w JOIN fact f ON f.mapping_id = w.mapping_id AND f.node = w.node WHERE upper(f.type) LIKE '%LOOKUP%') m LEFT JOIN a ON a.mapping_id = m.mapping_id AND a.instance = m.instance",
    "f24_conditions_used": f"{_B} SELECT DISTINCT w.mapping_id, w.start, f.instance, a.name AS condition_name, a.value AS condition_value FROM walk w JOIN fact f ON f.mapping_id = w.mapping_id AND f.node = w.node JOIN x_attr a ON a.mapping_id = f.mapping_id AND a.instance = f.instance WHERE f.type IN ('Filter', 'Router') AND lower(a.name) LIKE '%condition%'",
    "f25_unresolved_reasons": f"{_B} SELECT * FROM open_port",
    "f26_diagnostics": f"{_B} SELECT mapping_id, category, count(*) AS n FROM (SELECT mapping_id, CASE WHEN reason = 'no_incoming_connector' THEN 'missing_connector' ELSE 'unresolved_port' END AS category FROM open_port UNION ALL SELECT p.mapping_id, 'unresolved_expression' FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM paired q WHERE q.mapping_id = p.mapping_id AND q.instance = p.instance AND q.\"left\" = p.\"left\" AND q.\"right\" = p.\"right\")) GROUP BY 1, 2",
    "f27_final_targets": f"{_B} SELECT * FROM final",
    "f28_select_targets": f"{_B}, loads AS (SELECT mapping_id, target_instance, coalesce(try_cast(ord AS INTEGER), -1) AS place FROM x_load_order), cand AS (SELECT t.mapping_id, t.instance, CASE WHEN (t.subject_id, upper(t.definition)) IN (SELECT subject_id, definition FROM final) THEN 3 WHEN (t.mapping_id, t.instance) IN (SELECT l.mapping_id, l.target_instance FROM loads l JOIN (SELECT mapping_id, max(place) AS place FROM loads GROUP BY 1) m ON m.mapping_id = l.mapping_id AND m.place = l.place) THEN 4 WHEN (t.mapping_id, t.instance) IN (SELECT mapping_id, to_inst FROM x_conn) THEN 5 ELSE 6 END AS rule FROM x_inst t WHERE t.type = 'Target Definition') SELECT mapping_id, instance, rule FROM cand WHERE rule = (SELECT min(rule) FROM cand c WHERE c.mapping_id = cand.mapping_id)",
    "f29_scope_mappings": f"{_B}, live AS (SELECT workflow_id, task_name AS n FROM x_task WHERE upper(task_type) = 'SESSION' AND upper(coalesce(isenabled, 'YES')) = 'YES' AND task_name <> '' UNION SELECT workflow_id, name FROM x_task WHERE upper(task_type) = 'SESSION' AND upper(coalesce(isenabled, 'YES')) = 'YES' AND name <> '') SELECT DISTINCT s.mapping_name FROM live l ANTI JOIN (SELECT workflow_id, from_task AS n FROM x_link WHERE from_task <> '') o USING (workflow_id, n) JOIN (SELECT session_name, max_by(mapping_name, ord) AS mapping_name FROM x_session WHERE mapping_name <> '' GROUP BY 1) s ON s.session_name = l.n",
    "f30_target_fields": f"{_B} SELECT * FROM wanted",
    "f32_missing_fields": f"{_B} SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM start s WHERE s.mapping_id = w.mapping_id AND s.start = w.instance || '.' || w.field)",
    "f35_lookup_derivations": f"{_B}, kinds AS (SELECT mapping_id, instance, field, upper(porttype) LIKE '%LOOKUP%' AS is_lookup FROM x_port), {_DERIVED}, {_traced('''SELECT mapping_id, instance || '.' || driving_field AS start FROM drv WHERE is_traced''')} SELECT d.mapping_id, d.instance, lookup_field, driving_field, n_visited, sources FROM drv d LEFT JOIN found f ON f.mapping_id = d.mapping_id AND f.start = d.instance || '.' || driving_field AND d.is_traced",
    "f36_condition_derivations": f"{_B}, {_traced('''SELECT mapping_id, instance || '.' || field AS start FROM cond_field''')} SELECT c.mapping_id, c.instance, c.name, c.field, n_visited, sources FROM cond_field c JOIN found f ON f.mapping_id = c.mapping_id AND f.start = c.instance || '.' || c.field",
    "f37_involved_fields": f"{_B}, tie AS MATERIALIZED (SELECT mapping_id, node, parent FROM dep_edge UNION SELECT * FROM lookup_edge UNION SELECT a.mapping_id, a.instance || '.' || a.field, b.instance || '.' || b.field FROM cond_field a JOIN cond_field b ON a.mapping_id = b.mapping_id AND a.instance = b.instance AND a.name = b.name AND a.field <> b.field), both_ways AS MATERIALIZED (SELECT * FROM tie UNION SELECT mapping_id, parent, node FROM tie), inv AS (SELECT f.mapping_id, f.instance, f.node FROM walk w JOIN fact f ON f.mapping_id = w.mapping_id AND f.node = w.node WHERE {_TX} UNION SELECT i.mapping_id, i.instance, t.parent FROM inv i JOIN both_ways t ON t.mapping_id = i.mapping_id AND t.node = i.node) SELECT * FROM inv",
    "f38_expression_breakdown": f"{_B}, named AS (SELECT DISTINCT p.mapping_id, p.instance, p.field AS rule_field, p.expression, up.field FROM (SELECT *, unnest(regexp_extract_all(expression, '{_ND}')) AS tok FROM x_port WHERE {_TX} AND NOT {_PASS}) p JOIN up ON up.mapping_id = p.mapping_id AND up.instance = p.instance AND up.u = upper(regexp_extract(tok, '[^.]*$'))), {_traced('''SELECT mapping_id, instance || '.' || field AS start FROM named''')} SELECT n.mapping_id, n.instance, rule_field, expression, field, n_visited, sources FROM named n JOIN found f ON f.mapping_id = n.mapping_id AND f.start = n.instance || '.' || n.field",
}
