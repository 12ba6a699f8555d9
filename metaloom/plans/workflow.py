"""Queries of the workflow overview over export tables, and of summaries of traces, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.functions import sqltext
from metaloom.operators import inventory, overview, summary
from metaloom.operators import typed_edges as T
from metaloom.sources.fixture import repository, with_sql

from . import typed
from .lineage import ORACLE as _LINEAGE
from .lineage import e03 as _e03


def e01(spark, d):
    return overview.session_lookup(repository(spark, d)["x_session"])


def e02(spark, d):
    return overview.mapping_registry(repository(spark, d)["x_session"])


def e05(spark, d):
    return overview.distinct_in_order(repository(spark, d)["x_task"], ["workflow_id"], "task_name", "ord")


def e06(spark, d):
    return overview.task_sessions(repository(spark, d)["x_task"])


def e07(spark, d):
    repo = repository(spark, d)
    return overview.linked_sessions(repo["x_link"], repo["x_task"], repo["x_session"])


def e12(spark, d):
    return overview.mapping_ranks(e07(spark, d), repository(spark, d)["x_session"])


def e14(spark, d):
    return e07(spark, d).select("workflow_id", "from_session", "to_session", "condition")


def e15(spark, d):
    return overview.mapping_transformations(_e03(spark, d), repository(spark, d)["rep_all_mappings"].select("mapping_id", "mapping_name"))


def e20(spark, d):
    repo = repository(spark, d)
    return overview.load_order(repo["x_inst"], repo["x_load_order"])


def e24(spark, d):
    return overview.file_exports(repository(spark, d)["x_extension"])


def e25(spark, d):
    repo = repository(spark, d)
    return overview.terminal_mappings(repo["x_task"], repo["x_link"], repo["x_session"])


def b06(spark, d):
    return inventory.available_names(inventory.all_details(repository(spark, d)))


def b08(spark, d):
    return repository(spark, d)["rep_widget_inst"].select("widget_type_name", inventory.canonical_type("widget_type_name").alias("canon")).distinct()


def f41(spark, d):
    return repository(spark, d)["x_port"].where("type not in ('Source Definition', 'Target Definition')").select("mapping_id", "instance", "field", sqltext.plain_rule(F.col("expression")).alias("rule"))


def h05(spark, d):
    return summary.expression_lineage(typed.f36(spark, d))


def h07(spark, d):
    return summary.lookup_rows(typed.f22(spark, d))


def h08(spark, d):
    _, port, _, _, _, trace = typed._trace(spark, d)
    return summary.transformation_detail(trace, T.facts(port))


def i05(spark, d):
    """How each traced target field ends: its kind of source."""
    _, port, _, _, parent, trace = typed._trace(spark, d)
    return summary.terminal_kinds(trace, parent, T.facts(port))


def i06(spark, d):
    """Repository and export texts of the same condition that differ once white space is folded."""
    repo = repository(spark, d)
    detail = repo["rep_widget_attr"].join(repo["x_inst"].select(F.col("instance_id").alias("widget_id"), F.col("mapping_id").alias("m"), "instance"), "widget_id")
    detail = detail.where("trim(attr_value) <> ''").groupBy(F.col("m").alias("mapping_id"), "instance", F.col("attr_name").alias("name")).agg(F.min("attr_value").alias("value"))
    return summary.logic_mismatch(detail, repo["x_attr"].select("mapping_id", "instance", "name", F.upper("value").alias("value")))


def i08(spark, d):
    """Condition texts of the repository, gaps filled from the export, with where each comes from."""
    repo = repository(spark, d)
    export = repo["x_attr"].where("lower(name) like '%condition%'").select("mapping_id", "instance", "name", "value")
    detail = export.where("length(value) % 3 <> 0").withColumn("value", F.concat("value", F.lit(" ")))
    return summary.fill_logic(detail, export)


def i09(spark, d):
    """Conditions of each mapping, each text once, as one list."""
    rows = repository(spark, d)["x_attr"].where("lower(name) like '%condition%'")
    return summary.eligibility_summary(rows)


QUERIES = {
    "e01_session_lookup": e01, "e02_mapping_registry": e02, "e05_distinct_in_order": e05, "e06_task_sessions": e06, "e07_session_links": e07, "e12_mapping_ranks": e12, "e14_session_conditions": e14, "e15_mapping_transformations": e15, "e20_load_order": e20,
    "e24_file_exports": e24, "e25_terminal_mappings": e25, "b06_available_names": b06, "b08_canonical_types": b08, "f41_plain_rules": f41, "h05_expression_lineage": h05, "h07_lookup_rows": h07, "h08_transformation_detail": h08, "i05_terminal_kinds": i05, "i06_logic_mismatch": i06, "i08_fill_logic": i08, "i09_eligibility_summary": i09,
}

_W = with_sql()
_R = _W.replace("WITH ", "WITH RECURSIVE ", 1)
_SESS = "sess AS (SELECT session_name, max_by(mapping_name, ord) AS mapping_name FROM x_session WHERE session_name <> '' GROUP BY 1)"
_TASKS = "ts AS (SELECT workflow_id, task, max_by(session_name, (ord, session_name)) AS session_name FROM (SELECT workflow_id, name AS task, coalesce(nullif(task_name, ''), name) AS session_name, ord FROM x_task WHERE task_type = 'Session' UNION ALL SELECT workflow_id, task_name, coalesce(nullif(task_name, ''), name), ord FROM x_task WHERE task_type = 'Session') WHERE task <> '' GROUP BY 1, 2)"
_LINKS = f"""{_SESS}, {_TASKS}, live AS (SELECT * FROM x_link WHERE from_task <> '' AND to_task <> ''),
reach AS (SELECT DISTINCT workflow_id, 'Start' AS task FROM live WHERE from_task = 'Start' UNION SELECT r.workflow_id, l.to_task FROM reach r JOIN live l ON l.workflow_id = r.workflow_id AND l.from_task = r.task),
lk AS (SELECT l.workflow_id, from_task, to_task, condition, min(ord) AS ord FROM live l JOIN reach r ON r.workflow_id = l.workflow_id AND r.task = l.from_task GROUP BY ALL UNION ALL SELECT workflow_id, from_task, to_task, condition, ord FROM live WHERE workflow_id NOT IN (SELECT workflow_id FROM reach)),
links AS (SELECT lk.workflow_id, coalesce(f.session_name, lk.from_task) AS from_session, t.session_name AS to_session, coalesce(nullif(condition, ''), '[condition: none defined]') AS condition, coalesce(s.mapping_name, '') AS mapping_name, lk.ord FROM lk JOIN ts t ON t.workflow_id = lk.workflow_id AND t.task = lk.to_task LEFT JOIN ts f ON f.workflow_id = lk.workflow_id AND f.task = lk.from_task LEFT JOIN sess s ON s.session_name = t.session_name)"""
_RULE = r"""CASE WHEN trim(coalesce(expression, '')) = '' THEN 'No transformation logic provided'
WHEN regexp_matches(trim(expression), '^\s*(\w+)\s*$') THEN 'Pass through ' || trim(expression) || ' without change'
WHEN regexp_matches(expression, '(?i)IIF\s*\(\s*(.+?)\s*,\s*(.+?)\s*,\s*(.+?)\s*\)\s*$') THEN 'If ' || regexp_extract(expression, '(?i)IIF\s*\(\s*(.+?)\s*,\s*(.+?)\s*,\s*(.+?)\s*\)\s*$', 1) || ' then ' || regexp_extract(expression, '(?i)IIF\s*\(\s*(.+?)\s*,\s*(.+?)\s*,\s*(.+?)\s*\)\s*$', 2) || ', otherwise ' || regexp_extract(expression, '(?i)IIF\s*\(\s*(.+?)\s*,\s*(.+?)\s*,\s*(.+?)\s*\)\s*$', 3)
WHEN regexp_matches(expression, '(?i)DECODE\s*\(') THEN 'Map value using DECODE logic'
WHEN regexp_matches(expression, '(?i)L?R?TRIM\s*\(\s*\w+\s*\)\s*$') THEN 'Trim whitespace from ' || regexp_extract(expression, '(?i)TRIM\s*\(\s*(\w+)', 1)
WHEN regexp_matches(expression, '(?i)TO_CHAR\s*\(\s*\w+') THEN 'Convert ' || regexp_extract(expression, '(?i)TO_CHAR\s*\(\s*(\w+)', 1) || ' to text'
WHEN expression LIKE '%||%' THEN 'Concatenate values' WHEN regexp_matches(expression, '[-+*/]') THEN 'Apply arithmetic calculation' ELSE 'Apply expression: ' || expression END"""
_TB = typed.base()

ORACLE = {
    "e01_session_lookup": f"{_W}, {_SESS} SELECT * FROM sess",
    "e02_mapping_registry": f"{_W} SELECT mapping_name, min(ord) AS first_ord, max(ord) AS last_ord FROM x_session WHERE mapping_name <> '' GROUP BY 1",
    "e05_distinct_in_order": f"{_W} SELECT workflow_id, task_name, min(ord) AS ord FROM x_task WHERE trim(coalesce(task_name, '')) <> '' GROUP BY 1, 2",
    "e06_task_sessions": f"{_W}, {_TASKS} SELECT * FROM ts",
    "e07_session_links": f"{_R}, {_LINKS} SELECT * FROM links",
    "e12_mapping_ranks": f"{_R}, {_LINKS}, m AS (SELECT mapping_name, min(CASE WHEN kind = 0 THEN ord END) AS linked, min(ord) AS ord FROM (SELECT mapping_name, ord, 0 AS kind FROM links WHERE mapping_name <> '' UNION ALL SELECT mapping_name, ord, 1 FROM x_session WHERE mapping_name <> '') GROUP BY 1) SELECT mapping_name, CAST(row_number() OVER (ORDER BY linked IS NULL, linked, ord, mapping_name) AS BIGINT) AS rank FROM m",
    "e14_session_conditions": f"{_R}, {_LINKS} SELECT workflow_id, from_session, to_session, condition FROM links",
    "e15_mapping_transformations": f"{_W.replace('WITH ', 'WITH RECURSIVE ', 1)}, o AS ({_LINEAGE['e03_transformation_order']}) SELECT m.mapping_id, CASE WHEN coalesce(o.pos, 1) = 1 THEN m.mapping_name ELSE '' END AS shown_mapping, coalesce(o.node, '') AS transformation, o.pos FROM rep_all_mappings m LEFT JOIN o ON o.mapping_id = m.mapping_id",
    "e20_load_order": f"{_W}, g AS (SELECT mapping_id, target_instance, max(try_cast(ord AS INTEGER)) AS given FROM x_load_order WHERE target_instance <> '' AND ord <> '' GROUP BY 1, 2) SELECT t.mapping_id, t.instance, given, CAST(row_number() OVER (PARTITION BY t.mapping_id ORDER BY given NULLS LAST, t.ord) AS INTEGER) AS place FROM x_inst t LEFT JOIN g ON g.mapping_id = t.mapping_id AND g.target_instance = t.instance WHERE t.type = 'Target Definition'",
    "e24_file_exports": f"{_W} SELECT session_name, instance, subtype, file_name, directory FROM (SELECT session_name, ord, instance, subtype, coalesce(max(CASE WHEN name = 'Output filename' THEN value END), '') AS file_name, coalesce(max(CASE WHEN name = 'Output file directory' THEN value END), '') AS directory FROM x_extension WHERE type = 'WRITER' AND subtype LIKE '%File%' AND instance <> '' GROUP BY 1, 2, 3, 4) WHERE file_name <> '' OR directory <> ''",
    "e25_terminal_mappings": f"{_W}, live AS (SELECT workflow_id, task_name AS session_name FROM x_task WHERE upper(task_type) = 'SESSION' AND upper(coalesce(isenabled, 'YES')) = 'YES' AND task_name <> '' UNION SELECT workflow_id, name FROM x_task WHERE upper(task_type) = 'SESSION' AND upper(coalesce(isenabled, 'YES')) = 'YES' AND name <> '') SELECT l.workflow_id, l.session_name, s.mapping_name FROM live l JOIN (SELECT session_name, max_by(mapping_name, ord) AS mapping_name FROM x_session WHERE session_name <> '' AND mapping_name <> '' GROUP BY 1) s USING (session_name) WHERE NOT EXISTS (SELECT 1 FROM x_link k WHERE k.workflow_id = l.workflow_id AND k.from_task = l.session_name)",
    "b06_available_names": f"{_W}, n AS (SELECT DISTINCT i.instance_name FROM rep_widget_inst i JOIN rep_load_sessions s ON s.mapping_id = i.mapping_id JOIN rep_task_inst t ON t.task_id = s.session_id AND t.task_type = 68 ORDER BY 1 LIMIT 30) SELECT string_agg(instance_name, ', ' ORDER BY instance_name) AS available FROM n",
    "b08_canonical_types": f"{_W} SELECT DISTINCT widget_type_name, upper(regexp_replace(widget_type_name, '[^A-Za-z0-9]', '', 'g')) AS canon FROM rep_widget_inst",
    "f41_plain_rules": f"{_W} SELECT mapping_id, instance, field, {_RULE} AS rule FROM x_port WHERE type NOT IN ('Source Definition', 'Target Definition')",
    "h05_expression_lineage": f"WITH q AS ({typed.ORACLE['f36_condition_derivations']}) SELECT DISTINCT mapping_id, instance, name AS attribute, field, sources FROM q",
    "h07_lookup_rows": f"WITH q AS ({typed.ORACLE['f22_lookups_used']}) SELECT DISTINCT mapping_id, instance, coalesce(lookup_table, '') AS lookup_table, coalesce(lookup_condition, '') AS lookup_condition, coalesce(lookup_sql_override, '') AS lookup_sql_override, coalesce(lookup_source_filter, '') AS lookup_source_filter FROM q",
    "h08_transformation_detail": f"{_TB} SELECT DISTINCT f.mapping_id, f.instance, f.type, f.field, coalesce(f.expression, '') AS expression, {_RULE} AS rule FROM walk w JOIN fact f ON f.mapping_id = w.mapping_id AND f.node = w.node WHERE {typed._TX}",
    "i05_terminal_kinds": f"{_TB} SELECT DISTINCT w.mapping_id, w.start, CASE WHEN f.type IN ('Source Definition', 'Source Qualifier') THEN 'source' WHEN f.type = 'Sequence' THEN 'sequence' WHEN trim(coalesce(f.expression, '')) <> '' THEN 'constant or expression' ELSE 'unresolved' END AS kind FROM walk w LEFT JOIN fact f ON f.mapping_id = w.mapping_id AND f.node = w.node WHERE NOT EXISTS (SELECT 1 FROM parent p WHERE p.mapping_id = w.mapping_id AND p.node = w.node)",
    "i06_logic_mismatch": f"{_W}, dt AS (SELECT i.mapping_id, i.instance, a.attr_name AS name, min(a.attr_value) AS value FROM rep_widget_attr a JOIN x_inst i ON i.instance_id = a.widget_id WHERE trim(a.attr_value) <> '' GROUP BY 1, 2, 3), ex AS (SELECT mapping_id, instance, name, upper(value) AS value FROM x_attr), b AS (SELECT coalesce(dt.mapping_id, ex.mapping_id) AS mapping_id, coalesce(dt.instance, ex.instance) AS instance, coalesce(dt.name, ex.name) AS name, trim(regexp_replace(dt.value, '\\s+', ' ', 'g')) AS detail, trim(regexp_replace(ex.value, '\\s+', ' ', 'g')) AS export FROM dt FULL JOIN ex ON dt.mapping_id = ex.mapping_id AND dt.instance = ex.instance AND dt.name = ex.name) SELECT * FROM b WHERE detail IS DISTINCT FROM export",
    "i08_fill_logic": f"{_W} SELECT mapping_id, instance, name, CASE WHEN length(value) % 3 <> 0 THEN value || ' ' ELSE value END AS value, CASE WHEN length(value) % 3 <> 0 THEN 'detail' ELSE 'export' END AS provenance FROM x_attr WHERE lower(name) LIKE '%condition%'",
    "i09_eligibility_summary": f"{_W} SELECT mapping_id, count(DISTINCT trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS n_rules, string_agg(DISTINCT trim(regexp_replace(value, '\\s+', ' ', 'g')), '; ' ORDER BY trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS rules FROM x_attr WHERE lower(name) LIKE '%condition%' GROUP BY 1",
}
