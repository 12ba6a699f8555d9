"""Queries of conditions, references and summaries, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions import sqltext
from metaloom.operators import blocks, conditions, inventory, overview
from metaloom.sources.fixture import repository, with_sql
from metaloom.sources.store import cut

from . import lineage as L
from .metadata import ATTR_ROWS, BASE


def _parts(spark, d):
    repo = repository(spark, d)
    details = inventory.all_details(repo)
    rows = blocks.attr_rows(blocks.relevant(details), repo["rep_widget_attr"])
    return repo, details, rows, L.d12a(spark, d)


def g18(spark, d):
    _, details, rows, groups = _parts(spark, d)
    return conditions.conditions(rows, details.select("mapping_id", "instance_id", "widget_id", "widget_type").distinct(), groups)


def i10(spark, d):
    _, details, rows, groups = _parts(spark, d)
    found = conditions.conditions(rows, details.select("mapping_id", "instance_id", "widget_id", "widget_type").distinct(), groups)
    return conditions.zero_rule_mappings(details.select("mapping_id", "mapping_name").distinct(), found)


def g26(spark, d):
    return conditions.referential(_parts(spark, d)[2])


def f23(spark, d):
    repo = repository(spark, d)
    return conditions.lookups_reaching(repo["rep_mapping_conn_ports"], repo["rep_widget_inst"])


def d04a(spark, d):
    rows = repository(spark, d)["rep_widget_attr"].where("upper(trim(attr_name)) = 'JOIN CONDITION' and trim(attr_value) <> ''")
    left, op, right = sqltext.condition_parts(F.trim("attr_value"))
    return rows.select("widget_id", left.alias("condition_master"), op.alias("condition_operator"), right.alias("condition_detail"))


def d08b(spark, d):
    repo = repository(spark, d)
    return conditions.target_v2(repo["rep_widget_inst"], repo["rep_mapping_conn_ports"], repo["opb_widget_field"])


def d15b(spark, d):
    repo = repository(spark, d)
    inc = L.d15a(spark, d).select("mapping_id", "instance_id", "field_name", F.col("group_no").alias("group_order"), F.lit("INPUT").alias("group_type"), F.lit(1).alias("mask"))
    rel = blocks.relevant(inventory.all_details(repo).where("widget_type = 97"))
    out = blocks.outgoing(rel, repo["rep_mapping_conn_ports"]).select("mapping_id", "instance_id", "field_name", F.lit(0).alias("group_order"), F.lit("OUTPUT").alias("group_type"), F.lit(2).alias("mask")).distinct()
    return inc.distinct().unionByName(out)


def d15c(spark, d):
    fields = repository(spark, d)["opb_widget_field"].select(F.col("widget_id").alias("instance_id"), "field_name", "porttype")
    groups = d15b(spark, d)
    return groups.join(fields, ["instance_id", "field_name"]).where("(porttype & mask) <> 0").select("instance_id", "field_name", "group_order", "group_type")


def e13(spark, d):
    repo, details = repository(spark, d), None
    found = inventory.workflow_mappings(repo)
    details = repo["rep_widget_inst"].where("widget_type not in (1, 2)").select("mapping_id", F.col("instance_name").alias("transformation"), "widget_type_name")
    return found.join(details, "mapping_id", "left").select("workflow_name", "session_name", "mapping_id", "transformation", "widget_type_name")


def e16(spark, d):
    rows = e13(spark, d).where("transformation is not null")
    return conditions.suppressed(rows, ["workflow_name", "session_name", "mapping_id"], ["mapping_id", "transformation"]).select("workflow_name", "transformation", "shown_session_name", "shown_mapping_id")


def e23(spark, d):
    repo = repository(spark, d)
    order = overview.session_order(cut(repo["workflow_link"], "links"), repo["task"])
    return order.groupBy("workflow_id").agg(F.expr("listagg(session_name, ' -> ') WITHIN GROUP (ORDER BY layer, session_name)").alias("flow"))


def h01(spark, d):
    return conditions.lineage_summary(L._records(spark, d)[2])


def h04(spark, d):
    return conditions.lineage_detail(L._records(spark, d)[2])


def h06(spark, d):
    return L._records(spark, d)[2].where("primary_rule is not null").select("mapping_id", "start", "primary_rule")


QUERIES = {"g18_conditions": g18, "i10_zero_rule_mappings": i10, "g26_referential": g26, "f23_lookups_reaching": f23, "d04a_join_condition": d04a, "d08b_target_v2": d08b, "d15b_group_ports": d15b, "d15c_ports_of_groups": d15c, "e13_wsmt_table": e13, "e16_suppress_repeats": e16, "e23_session_flow": e23, "h01_lineage_summary": h01, "h04_lineage_detail": h04, "h06_rule_rows": h06}

_COND = f"""{BASE}, {ATTR_ROWS}, ty AS (SELECT DISTINCT mapping_id, instance_id, widget_id, widget_type FROM details),
rule AS (SELECT * FROM (VALUES {', '.join(f"({c}, '{n}', '{'filter' if n == 'SQL QUERY' else b}')" for c, n, b in conditions.RULES)}) AS r(widget_type, label, bucket)),
cond AS (SELECT DISTINCT * FROM (SELECT t.mapping_id, t.instance_id, t.widget_type, r.bucket, r.label, trim(regexp_replace(CASE WHEN r.label = 'SQL QUERY' THEN regexp_extract(a.attr_value, 'WHERE (.*) ORDER BY', 1) ELSE a.attr_value END, '\\s+', ' ', 'g')) AS text FROM attr_rows a JOIN ty t ON t.mapping_id = a.mapping_id AND t.instance_id = a.instance_id JOIN rule r ON r.widget_type = t.widget_type AND r.label = a.attr_name WHERE a.attr_value IS NOT NULL
UNION ALL SELECT t.mapping_id, t.instance_id, t.widget_type, 'filter', concat('GROUP ', g.group_name), g.group_condition FROM ty t JOIN (SELECT object_id, group_id, max(CASE WHEN attr_id = 1 THEN trim(attr_value) END) AS group_name, max(CASE WHEN attr_id = 3 THEN trim(attr_value) END) AS group_condition FROM opb_table_group WHERE object_type = 15 GROUP BY 1, 2) g ON g.object_id = t.widget_id WHERE t.widget_type = 15 AND group_condition IS NOT NULL))"""
_WS = f"{with_sql()}, f AS (SELECT DISTINCT w.workflow_name, s.session_name, s.mapping_id FROM rep_workflows w JOIN rep_task_inst t ON t.workflow_id = w.workflow_id AND t.task_type = 68 JOIN rep_load_sessions s ON s.session_id = t.task_id), wsmt AS (SELECT f.*, i.instance_name AS transformation, i.widget_type_name FROM f LEFT JOIN rep_widget_inst i ON i.mapping_id = f.mapping_id AND i.widget_type NOT IN (1, 2))"
_GROUPS = f"{BASE}, cu AS (SELECT DISTINCT instance_id FROM details WHERE widget_type = 97), gp AS (SELECT DISTINCT mapping_id, instance_id, field_name, group_order, 'INPUT' AS group_type, 1 AS mask FROM (SELECT c.mapping_id, c.to_object_instance_id AS instance_id, c.to_object_field_name AS field_name, CAST(dense_rank() OVER (PARTITION BY c.mapping_id, c.to_object_instance_id ORDER BY c.from_object_name) AS INTEGER) AS group_order FROM rep_mapping_conn_ports c JOIN cu ON cu.instance_id = c.to_object_instance_id) UNION ALL SELECT DISTINCT c.mapping_id, c.from_object_instance_id, c.from_object_field_name, 0, 'OUTPUT', 2 FROM rep_mapping_conn_ports c JOIN cu ON cu.instance_id = c.from_object_instance_id)"

ORACLE = {
    "g18_conditions": f"{_COND} SELECT * FROM cond",
    "i10_zero_rule_mappings": f"{_COND} SELECT DISTINCT mapping_id, mapping_name FROM details WHERE mapping_id NOT IN (SELECT mapping_id FROM cond)",
    "g26_referential": f"{BASE}, {ATTR_ROWS}, w AS (SELECT mapping_id, instance_id, max(CASE WHEN attr_name = 'LOOKUP TABLE NAME' THEN attr_value END) AS own, max(CASE WHEN attr_name = 'LOOKUP SQL OVERRIDE' THEN attr_value END) AS override, max(CASE WHEN attr_name = 'LOOKUP CONDITION' THEN attr_value END) AS condition FROM attr_rows WHERE attr_name IN ('LOOKUP TABLE NAME', 'LOOKUP SQL OVERRIDE', 'LOOKUP CONDITION') GROUP BY 1, 2) SELECT mapping_id, instance_id, coalesce(own, regexp_extract(override, 'FROM (\\w+)', 1)) AS table_name, coalesce(array_to_string(list_sort(list_distinct({L._TOKENS.format(x='condition')})), ','), '') AS fields FROM w",
    "f23_lookups_reaching": f"{L._REC}, ie AS MATERIALIZED (SELECT DISTINCT mapping_id, from_object_instance_id AS src, to_object_instance_id AS dst FROM rep_mapping_conn_ports), r AS (SELECT e.mapping_id, e.src AS lookup, e.dst AS instance_id FROM ie e JOIN rep_widget_inst w ON w.instance_id = e.src AND w.widget_type = 11 UNION SELECT r.mapping_id, r.lookup, e.dst FROM r JOIN ie e ON e.mapping_id = r.mapping_id AND e.src = r.instance_id) SELECT * FROM r",
    "d04a_join_condition": f"{with_sql('rep_widget_attr')}, c AS (SELECT widget_id, trim(attr_value) AS x, regexp_extract(attr_value, '<>|!=|<=|>=|=|<|>') AS o FROM rep_widget_attr WHERE upper(trim(attr_name)) = 'JOIN CONDITION' AND trim(attr_value) <> '') SELECT widget_id, CASE WHEN o <> '' THEN trim(regexp_extract(x, '^(.*?)\\s*(<>|!=|<=|>=|=|<|>)', 1)) END AS condition_master, CASE WHEN o <> '' THEN o END AS condition_operator, CASE WHEN o <> '' THEN trim(regexp_replace(x, '^.*?(<>|!=|<=|>=|=|<|>)', '')) END AS condition_detail FROM c",
    "d08b_target_v2": f"{with_sql()}, t AS (SELECT c.mapping_id, c.to_object_instance_id AS instance_id, c.to_object_field_name AS port_name, max(f.wgt_datatype) AS datatype_code, max(f.wgt_prec) AS prec, string_agg(DISTINCT concat(from_object_name, '.', from_object_field_name), ', ' ORDER BY concat(from_object_name, '.', from_object_field_name)) AS feeders FROM rep_mapping_conn_ports c JOIN rep_widget_inst w ON w.mapping_id = c.mapping_id AND w.instance_id = c.to_object_instance_id AND w.widget_type = 2 LEFT JOIN opb_widget_field f ON f.widget_id = c.from_object_instance_id AND f.field_name = c.from_object_field_name GROUP BY 1, 2, 3) SELECT *, CAST(row_number() OVER (PARTITION BY mapping_id, instance_id ORDER BY port_name) AS INTEGER) AS port_order FROM t",
    "d15b_group_ports": f"{_GROUPS} SELECT * FROM gp",
    "d15c_ports_of_groups": f"{_GROUPS} SELECT gp.instance_id, gp.field_name, group_order, group_type FROM gp JOIN opb_widget_field f ON f.widget_id = gp.instance_id AND f.field_name = gp.field_name WHERE (porttype & mask) <> 0",
    "e13_wsmt_table": f"{_WS} SELECT workflow_name, session_name, mapping_id, transformation, widget_type_name FROM wsmt",
    "e16_suppress_repeats": f"{_WS} SELECT workflow_name, transformation, CASE WHEN lag(session_name) OVER w = session_name THEN '' ELSE session_name END AS shown_session_name, CASE WHEN lag(mapping_id) OVER w = mapping_id THEN '' ELSE CAST(mapping_id AS VARCHAR) END AS shown_mapping_id FROM wsmt WHERE transformation IS NOT NULL WINDOW w AS (PARTITION BY workflow_name ORDER BY mapping_id, transformation)",
    "e23_session_flow": L.ORACLE["e08_session_order"].replace("SELECT t.workflow_id, t.session_name, top.layer, predecessors, conditions FROM", "SELECT t.workflow_id, string_agg(t.session_name, ' -> ' ORDER BY top.layer, t.session_name) AS flow FROM") + " GROUP BY 1",
    "h01_lineage_summary": f"{L._RECORDS} SELECT count(*) AS records, count(DISTINCT mapping_id) AS mappings, count(primary_rule) AS with_rule, CAST(sum(n_lookups) AS BIGINT) AS lookups, CAST(sum(n_visited) AS BIGINT) AS visited FROM records",
    "h04_lineage_detail": f"{L._RECORDS} SELECT mapping_id, CAST(row_number() OVER (PARTITION BY mapping_id ORDER BY start) AS INTEGER) AS row_no, start, CASE WHEN sources = '' THEN 'Not found' ELSE sources END AS sources, coalesce(primary_rule, 'Direct move') AS rule FROM records",
    "h06_rule_rows": f"{L._RECORDS} SELECT mapping_id, start, primary_rule FROM records WHERE primary_rule IS NOT NULL",
}
