"""Queries of the inventory, block and extract operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions import decode
from metaloom.operators import blocks, extract, inventory
from metaloom.sources.fixture import repository, with_sql
from metaloom.sources.store import cut

KEYS = ", ".join(blocks.KEYS)
FOUND = "found AS (SELECT DISTINCT w.subject_area, w.subject_id, w.workflow_name, t.instance_name AS session_instance_name, s.session_name, s.mapping_id FROM rep_workflows w JOIN rep_task_inst t ON t.workflow_id = w.workflow_id AND t.task_type = 68 JOIN rep_load_sessions s ON s.session_id = t.task_id)"
DETAILS = FOUND + ",\ndetails AS (SELECT DISTINCT f.*, m.mapping_name, i.instance_id, i.instance_name, i.widget_id, i.widget_type, i.widget_type_name, i.version_number FROM found f JOIN rep_all_mappings m ON m.mapping_id = f.mapping_id JOIN rep_widget_inst i ON i.mapping_id = f.mapping_id AND i.subject_id = f.subject_id)"
ATTR_ROWS = f"""attr_rows AS (SELECT r.{', r.'.join(blocks.KEYS)}, a.attr_id, a.line_no, upper(trim(a.attr_name)) AS attr_name, nullif(trim(a.attr_value), '') AS attr_value
FROM (SELECT DISTINCT {KEYS}, widget_type FROM details) r JOIN rep_widget_attr a ON a.widget_id = r.widget_id AND a.version_number = r.version_number
AND (a.instance_id IS NULL OR a.instance_id = 0 OR a.instance_id = r.instance_id) AND (a.mapping_id IS NULL OR a.mapping_id = 0 OR a.mapping_id = r.mapping_id) AND (a.widget_type IS NULL OR a.widget_type = r.widget_type))"""
NEIGHBOURS = """inc AS (SELECT DISTINCT subject_id, mapping_id, to_object_instance_id AS instance_id, to_object_field_name AS field_name, from_object_name AS object_name, concat(from_object_name, '.', from_object_field_name) AS connected FROM rep_mapping_conn_ports),
outg AS (SELECT DISTINCT subject_id, mapping_id, from_object_instance_id AS instance_id, from_object_field_name AS field_name, to_object_name AS object_name, concat(to_object_name, '.', to_object_field_name) AS connected FROM rep_mapping_conn_ports),
prev AS (SELECT subject_id, mapping_id, instance_id, field_name, string_agg(connected, ', ' ORDER BY connected) AS previous_transformation FROM inc GROUP BY ALL),
nxt AS (SELECT subject_id, mapping_id, instance_id, field_name, string_agg(connected, ', ' ORDER BY connected) AS next_transformation FROM outg GROUP BY ALL),
conn AS (SELECT * FROM prev FULL JOIN nxt USING (subject_id, mapping_id, instance_id, field_name))"""
BASE = f"{with_sql()},\n{DETAILS}"


def _in(spec: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in spec) + ")"


def extract_sql(spec: extract.Spec) -> str:
    props = ", ".join(f"max(CASE WHEN attr_name IN {_in(ns)} THEN attr_value END) AS {c}" for c, ns in spec.pivot.items())
    expr = """, x AS (SELECT e.widget_id, e.version_number, e.output_field_id AS field_id, CAST(t.line_no AS BIGINT) AS expression_line_no, t.expression FROM opb_widget_expr e LEFT JOIN opb_expression t ON t.widget_id = e.widget_id AND t.version_number = e.version_number AND t.expr_id = e.expr_id)"""
    cols = ", ".join(f"{sql} AS {name}" for name, sql in extract._columns(spec).items())
    return f"""{BASE},
{ATTR_ROWS},
props AS (SELECT {KEYS}, {props} FROM attr_rows GROUP BY {KEYS}),
ext AS (SELECT subject_id, metadata_extn_object_id AS widget_id, version_number, metadata_extn_name AS extension_name, {decode.extension_type('metadata_extn_data_type')} AS extension_datatype, CAST(length(metadata_extn_value) AS BIGINT) AS extension_prec, metadata_extn_value AS extension_value, CASE WHEN domain_id IS NOT NULL THEN 'YES' ELSE 'NO' END AS reusable, CAST(line_no AS BIGINT) AS extension_line_no FROM rep_metadata_extns),
{NEIGHBOURS}{expr if spec.code == 5 else ''},
allc AS (SELECT i.subject_area, i.workflow_name, i.session_instance_name, i.session_name, i.mapping_name, i.instance_name AS transformation_name, i.widget_type_name AS transformation_type, f.*, props.* EXCLUDE ({KEYS}), ext.* EXCLUDE (subject_id, widget_id, version_number), previous_transformation, next_transformation{', x.expression_line_no, x.expression' if spec.code == 5 else ''}
FROM details i JOIN opb_widget_field f ON f.widget_id = i.widget_id AND f.version_number = i.version_number
LEFT JOIN props ON props.subject_id = i.subject_id AND props.mapping_id = i.mapping_id AND props.instance_id = i.instance_id AND props.widget_id = i.widget_id AND props.version_number = i.version_number
LEFT JOIN ext ON ext.subject_id = i.subject_id AND ext.widget_id = i.widget_id AND ext.version_number = i.version_number
LEFT JOIN conn ON conn.subject_id = i.subject_id AND conn.mapping_id = i.mapping_id AND conn.instance_id = i.instance_id AND conn.field_name = f.field_name
{'LEFT JOIN x ON x.widget_id = f.widget_id AND x.version_number = f.version_number AND x.field_id = f.field_id' if spec.code == 5 else ''}
WHERE i.widget_type = {spec.code})
SELECT DISTINCT {', '.join(blocks.SCOPE)}, transformation_name, transformation_type, {cols} FROM allc"""


def _details(spark: SparkSession, sf_dir: str):
    repo = repository(spark, sf_dir)
    return repo, inventory.all_details(repo)


def _extract(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        repo, details = _details(spark, sf_dir)
        return extract.extract(repo, details, extract.SPECS[name])

    return query


def _rows(spark: SparkSession, sf_dir: str):
    repo, details = _details(spark, sf_dir)
    return repo, blocks.attr_rows(blocks.relevant(details), repo["rep_widget_attr"])


def b01(spark, d):
    return inventory.workflow_mappings(repository(spark, d))


def b02(spark, d):
    return inventory.all_details(repository(spark, d))


def b03(spark, d):
    return inventory.workflow_mappings(repository(spark, d), subject="ASIA")


def b04(spark, d):
    repo, details = _details(spark, d)
    routed = repo["rep_widget_inst"].where("widget_type = 15").select("mapping_id")
    names = repo["rep_all_mappings"].join(routed, "mapping_id", "left_semi").select("mapping_name")
    return inventory.scope_mapping(details, repo["rep_all_mappings"].select("mapping_id", "subject_id", "mapping_name"), names)


def _names(inst):
    """A list of names from each instance: its own twice, and one that no instance bears."""
    texts = inst.selectExpr("concat(' ', lower(instance_name), ', X', cast(instance_id % 7 as string), ',', instance_name) AS names")
    return inventory.requested_names(texts, "names")


def b05(spark, d):
    return _names(repository(spark, d)["rep_widget_inst"]).select("folded")


def b06(spark, d):
    repo, details = _details(spark, d)
    return inventory.missing_requested(_names(repo["rep_widget_inst"]), details).select(F.lower("name").alias("name"))


def b07(spark, d):
    repo, details = _details(spark, d)
    return inventory.restrict(details, _names(repo["rep_widget_inst"].where("widget_type in (13, 15)")))


def b09(spark, d):
    repo = repository(spark, d)
    types = repo["rep_widget_inst"].select(F.col("widget_type_name").alias("type_name"))
    return inventory.query_for_type(types, spark.createDataFrame(ALIASES, "alias string, query string"))


ALIASES = [("FILTER", "FILTER"), ("EXPRESSION", "EXPRESSION"), ("LOOKUP", "LOOKUP"), ("LOOKUPPROC", "LOOKUP"), ("SOURCEQUALIFIER", "SOURCE_QUALIFIER"), ("SOURCE", "SOURCE_DEFINITION"), ("TARGET", "TARGET_DEFINITION"), ("CUSTOM", "CUSTOM"), ("SEQUENCEGENERATOR", "SEQUENCE")]


def b10(spark, d):
    return inventory.coverage_audit(_details(spark, d)[1])


def _all(spark, d):
    """Every registered extract, over tables that are joined once for all."""
    repo, details = _details(spark, d)
    details = cut(details, "details")
    return details, extract.extracts(repo, details)


def b11_all(spark, d):
    details, extracts = _all(spark, d)
    return inventory.run_summary(spark, extracts, inventory.coverage_audit(details)).drop("message")


def b12_all(spark, d):
    return inventory.combine_by_mapping({n: cut(make(), n) for n, make in _all(spark, d)[1].items()})


def b13(spark, d):
    repo, details = _details(spark, d)
    return inventory.leak_check(details, repo["rep_all_mappings"].where("subject_area = 'ASIA'").select("mapping_name")).select("mapping_name", "instance_name")


def b08_keys(spark, d):
    return repository(spark, d)["rep_widget_inst"].select("widget_type_name", inventory.type_key("widget_type_name").alias("type_key")).distinct()


def b10_instances(spark, d):
    return inventory.instance_coverage(_details(spark, d)[1])


def b14(spark, d):
    return inventory.types_present(_details(spark, d)[1])


def b15(spark, d):
    return inventory.mapplet_instances(_details(spark, d)[1])


def c01(spark, d):
    return blocks.instances(_details(spark, d)[1], F.col("widget_type_name").like("%Lookup%")).select("transformation_name", "transformation_type", "mapping_name")


def c03(spark, d):
    return _rows(spark, d)[1].select(*blocks.KEYS, "attr_id", "attr_name", "attr_value")


def c09(spark, d):
    repo, details = _details(spark, d)
    return blocks.extensions(blocks.relevant(details), repo["rep_metadata_extns"])


def c11(spark, d):
    repo, details = _details(spark, d)
    return blocks.incoming(blocks.relevant(details), repo["rep_mapping_conn_ports"])


def c12(spark, d):
    repo, details = _details(spark, d)
    return blocks.outgoing(blocks.relevant(details), repo["rep_mapping_conn_ports"])


def c14(spark, d):
    repo, details = _details(spark, d)
    rel, conn = blocks.relevant(details), repo["rep_mapping_conn_ports"]
    return blocks.port_connections(blocks.incoming(rel, conn), blocks.outgoing(rel, conn))


def c15(spark, d):
    repo, details = _details(spark, d)
    rel, conn = blocks.relevant(details), repo["rep_mapping_conn_ports"]
    return blocks.port_connections_full(blocks.incoming(rel, conn), blocks.outgoing(rel, conn))


def c16(spark, d):
    cols = [f"{decode.datatype('wgt_datatype')} AS datatype", *[f"{decode.port_flag('porttype', b)} AS bit_{b}" for b in "iolrv"], *[f"{decode.port_flag_equal('porttype', b)} AS eq_{b}" for b in "iov"]]
    return repository(spark, d)["opb_widget_field"].selectExpr("widget_id", "field_id", *cols)


_C16 = ", ".join([f"{decode.datatype('wgt_datatype')} AS datatype", *[f"{decode.port_flag('porttype', b)} AS bit_{b}" for b in "iolrv"], *[f"{decode.port_flag_equal('porttype', b)} AS eq_{b}" for b in "iov"]])
_DECODES = {
    **{f"tracing_{v}": decode.tracing("attr_value", v) for v in ("expression", "joiner", "generic", "lookup")},
    **{f"yes_no_{v}": decode.yes_no("attr_value", v) for v in ("generic", "lookup", "joiner")},
    "scope": decode.scope("attr_value"), "join_type": decode.join_type("attr_value"), "null_order": decode.null_order("attr_value"), "is_reusable": "CASE WHEN upper(attr_name) LIKE '%REUSABLE%' THEN 'YES' ELSE 'NO' END",
}


def c05(spark, d):
    rows = repository(spark, d)["rep_widget_attr"]
    return rows.selectExpr("widget_id", "attr_id", "nullif(trim(attr_value), '') AS attr_value", "attr_name").selectExpr("widget_id", "attr_id", *[f"{sql} AS {n}" for n, sql in _DECODES.items()])


def c20(spark, d):
    repo, details = _details(spark, d)
    out = blocks.port_expressions(blocks.relevant(details), repo["opb_widget_field"], repo["opb_widget_expr"], repo["opb_expression"])
    return out.select("widget_id", "field_id", "expression_line_no", "expression")


def c21(spark, d):
    return blocks.joined_expressions(repository(spark, d)["opb_expression"])


def c22(spark, d):
    return blocks.long_text(_rows(spark, d)[1], ("LOOKUP SQL OVERRIDE", "SQL QUERY"), "\n", True)


QUERIES = {
    "b01_workflow_mappings": b01, "b02_all_details": b02, "b03_scope": b03, "b04_scope_mapping": b04, "b05_requested_names": b05, "b06_missing_requested": b06, "b07_restrict": b07, "b09_query_for_type": b09, "b10_coverage_audit": b10, 
    "b11_run_summary": b11_all, "b12_combine_all": b12_all, "b08_type_keys": b08_keys, "b10_instance_coverage": b10_instances, "b13_leak_check": b13, "b14_types_present": b14, "b15_mapplet_instances": b15, "c01_instances": c01, "c03_attr_rows": c03, "c05_decodes": c05, "c09_extensions": c09, "c11_incoming": c11, "c12_outgoing": c12, "c14_port_connections": c14,
    "c15_port_connections_full": c15, "c16_ports": c16, "c20_port_expressions": c20, "c21_joined_expressions": c21, "c22_long_text": c22,
    **{name: _extract(name) for name in extract.SPECS},
}


def _names_sql(where: str = "") -> str:
    return f"names AS (SELECT DISTINCT lower(trim(x)) AS folded FROM (SELECT unnest(string_split(concat(' ', lower(instance_name), ', X', CAST(instance_id % 7 AS VARCHAR), ',', instance_name), ',')) AS x FROM rep_widget_inst {where}) WHERE trim(x) <> '')"

_DETAIL_COLS = "subject_area, subject_id, workflow_name, session_instance_name, session_name, mapping_id, mapping_name, instance_id, instance_name, widget_id, widget_type, widget_type_name, version_number"
_ALIAS_SQL = "(VALUES " + ", ".join(f"('{a}', '{q}')" for a, q in ALIASES) + ") AS a(alias, query)"
_CODES = ", ".join(map(str, inventory.REGISTRY))


ORACLE = {
    "b01_workflow_mappings": f"{with_sql('rep_all_mappings')}, {FOUND} SELECT * FROM found",
    "b02_all_details": f"{BASE} SELECT {_DETAIL_COLS} FROM details",
    "b03_scope": f"{with_sql('rep_all_mappings')}, {FOUND} SELECT * FROM found WHERE subject_area = 'ASIA'",
    "b04_scope_mapping": f"{BASE} SELECT {_DETAIL_COLS} FROM details WHERE mapping_id IN (SELECT mapping_id FROM rep_all_mappings m WHERE m.subject_id = details.subject_id AND mapping_id IN (SELECT mapping_id FROM rep_widget_inst WHERE widget_type = 15))",
    "b05_requested_names": f"{with_sql('rep_widget_inst')}, {_names_sql()} SELECT folded FROM names",
    "b06_missing_requested": f"{BASE}, {_names_sql()} SELECT folded AS name FROM names WHERE folded NOT IN (SELECT lower(trim(instance_name)) FROM details)",
    "b07_restrict": f"{BASE}, {_names_sql('WHERE widget_type IN (13, 15)')} SELECT {_DETAIL_COLS} FROM details WHERE lower(trim(instance_name)) IN (SELECT folded FROM names)",
    "b09_query_for_type": f"{with_sql('rep_widget_inst')}, t AS (SELECT DISTINCT widget_type_name AS type_name, upper(regexp_replace(widget_type_name, '[^A-Za-z0-9]', '', 'g')) AS canon FROM rep_widget_inst) SELECT type_name, (SELECT query FROM {_ALIAS_SQL} WHERE contains(canon, alias) OR contains(alias, canon) ORDER BY canon = alias DESC, length(alias) DESC, alias DESC LIMIT 1) AS query FROM t",
    "b08_type_keys": f"{with_sql('rep_widget_inst')} SELECT DISTINCT widget_type_name, CASE upper(replace(widget_type_name, ' ', '')) WHEN 'SEQUENCE' THEN 'SEQUENCEGENE' ELSE upper(replace(widget_type_name, ' ', '')) END AS type_key FROM rep_widget_inst",
    "b10_instance_coverage": f"{BASE} SELECT DISTINCT mapping_name, instance_name, widget_type_name, CASE WHEN widget_type IN ({_CODES}) THEN 'PRESENT' ELSE 'MISSING' END AS status FROM details",
    "b10_coverage_audit": f"{BASE} SELECT widget_type, widget_type_name, count(DISTINCT (mapping_id, instance_id)) AS instances, count(DISTINCT mapping_id) AS mappings, CASE WHEN widget_type IN ({_CODES}) THEN 'PRESENT' ELSE 'MISSING' END AS status FROM details GROUP BY 1, 2",
    "b11_run_summary": " UNION ALL ".join(f"SELECT '{n}' AS query_name, 'SUCCESS' AS status, count(*) AS row_count, count(DISTINCT mapping_name) AS mapping_count, 'ALL' AS subject_scope, 'ALL' AS workflow_scope FROM ({extract_sql(spec)})" for n, spec in extract.SPECS.items())
    + f" UNION ALL SELECT * FROM ({BASE} SELECT widget_type_name, 'MISSING', 0, count(DISTINCT mapping_id), 'ALL', 'ALL' FROM details WHERE widget_type NOT IN ({_CODES}) GROUP BY widget_type, widget_type_name)",
    "b12_combine_all": " UNION ALL BY NAME ".join(f"SELECT *, '{n}' AS query_name FROM ({extract_sql(spec)})" for n, spec in extract.SPECS.items()),
    "b13_leak_check": f"{BASE} SELECT mapping_name, instance_name FROM details WHERE mapping_name NOT IN (SELECT mapping_name FROM rep_all_mappings WHERE subject_area = 'ASIA')",
    "b14_types_present": f"{BASE} SELECT DISTINCT widget_type_name FROM details",
    "b15_mapplet_instances": f"{BASE} SELECT workflow_name, count(*) AS mapplets FROM details WHERE widget_type = 44 GROUP BY 1",
    "c01_instances": f"{BASE} SELECT instance_name AS transformation_name, widget_type_name AS transformation_type, mapping_name FROM details WHERE widget_type_name LIKE '%Lookup%'",
    "c03_attr_rows": f"{BASE}, {ATTR_ROWS} SELECT {KEYS}, attr_id, attr_name, attr_value FROM attr_rows",
    "c05_decodes": f"{with_sql('rep_widget_attr')} SELECT widget_id, attr_id, {', '.join(f'{sql} AS {n}' for n, sql in _DECODES.items())} FROM (SELECT widget_id, attr_id, nullif(trim(attr_value), '') AS attr_value, attr_name FROM rep_widget_attr)",
    "c09_extensions": f"{BASE} SELECT e.subject_id, metadata_extn_object_id AS widget_id, e.version_number, metadata_extn_name AS extension_name, {decode.extension_type('metadata_extn_data_type')} AS extension_datatype, CAST(length(metadata_extn_value) AS BIGINT) AS extension_prec, metadata_extn_value AS extension_value, CASE WHEN domain_id IS NOT NULL THEN 'YES' ELSE 'NO' END AS reusable, CAST(line_no AS BIGINT) AS extension_line_no FROM rep_metadata_extns e WHERE metadata_extn_object_id IN (SELECT widget_id FROM details)",
    "c11_incoming": f"{BASE}, {NEIGHBOURS} SELECT inc.* FROM inc SEMI JOIN details USING (mapping_id, instance_id)",
    "c12_outgoing": f"{BASE}, {NEIGHBOURS} SELECT outg.* FROM outg SEMI JOIN details USING (mapping_id, instance_id)",
    "c14_port_connections": f"{BASE}, {NEIGHBOURS} SELECT conn.* FROM conn SEMI JOIN details USING (mapping_id, instance_id)",
    "c15_port_connections_full": f"{BASE}, {NEIGHBOURS} SELECT conn.* FROM conn SEMI JOIN details USING (mapping_id, instance_id)",
    "c16_ports": f"{with_sql('opb_widget_field')} SELECT widget_id, field_id, {_C16} FROM opb_widget_field",
    "c20_port_expressions": f"{BASE} SELECT f.widget_id, f.field_id, CAST(t.line_no AS BIGINT) AS expression_line_no, coalesce(t.expression, '- N/A -') AS expression FROM opb_widget_field f LEFT JOIN opb_widget_expr e ON e.widget_id = f.widget_id AND e.output_field_id = f.field_id LEFT JOIN opb_expression t ON t.widget_id = e.widget_id AND t.expr_id = e.expr_id WHERE f.widget_id IN (SELECT widget_id FROM details)",
    "c21_joined_expressions": f"{with_sql('opb_expression')} SELECT widget_id, version_number, expr_id, string_agg(expression, ' ' ORDER BY line_no) AS expression FROM opb_expression GROUP BY ALL",
    "c22_long_text": f"{BASE}, {ATTR_ROWS} SELECT {KEYS}, rtrim(string_agg(attr_value, chr(10) ORDER BY line_no, attr_id, attr_value)) AS long_text FROM attr_rows WHERE attr_name IN ('LOOKUP SQL OVERRIDE', 'SQL QUERY') AND attr_value IS NOT NULL GROUP BY ALL",
    **{name: extract_sql(spec) for name, spec in extract.SPECS.items()},
}
