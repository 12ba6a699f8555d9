"""Queries of the extracts' special tabs, with DuckDB SQL by hand."""

from __future__ import annotations

from metaloom.operators import inventory, special
from metaloom.sources.fixture import repository

from .metadata import ATTR_ROWS, BASE, NEIGHBOURS

_NAMES = {"lookup": "d02_lookup_tab", "joiner": "d04_joiner_tab", "source_qualifier": "d05_qualifier_tab", "sequence": "d09_sequence_ports", "normalizer": "d11_normalizer_tab", "router": "d12_router_tab", "aggregator": "d13_aggregator_tab", "custom": "d15_custom_tab", "stored_procedure": "d16_procedure_tab", "transaction_control": "d17_control_ports"}


def _query(name: str):
    def query(spark, d):
        repo = repository(spark, d)
        return special.special_extract(repo, inventory.all_details(repo), name)

    return query


QUERIES = {shown: _query(name) for name, shown in _NAMES.items()}

_EXT = "ext AS (SELECT DISTINCT subject_id, metadata_extn_object_id AS widget_id, metadata_extn_name AS extension_name, CASE metadata_extn_data_type WHEN 1 THEN 'String' WHEN 2 THEN 'Number' WHEN 3 THEN 'Boolean' ELSE 'Other (' || metadata_extn_data_type || ')' END AS extension_datatype, length(metadata_extn_value) AS extension_prec, metadata_extn_value AS extension_value, CASE WHEN domain_id IS NOT NULL OR domain_name IS NOT NULL THEN 'YES' ELSE 'NO' END AS reusable, permissions AS extension_permissions, CAST(line_no AS BIGINT) AS extension_line_no, domain_name AS extension_domain_name, domain_usage AS extension_domain_usage, metadata_extn_description AS extension_description FROM rep_metadata_extns)"
_LINES = "lin AS (SELECT e.widget_id, e.output_field_id AS field_id, e.expr_id, e.expr_type, t.line_no, t.expression FROM opb_widget_expr e LEFT JOIN opb_expression t ON t.widget_id = e.widget_id AND t.expr_id = e.expr_id)"
_SIDES = "CASE WHEN o <> '' THEN nullif(trim(regexp_extract(x, '^(.*?)\\s*(<>|!=|<=|>=|=|<|>)', 1)), '') END AS l, CASE WHEN o <> '' THEN o END AS o, CASE WHEN o <> '' THEN nullif(trim(regexp_replace(x, '^.*?(<>|!=|<=|>=|=|<|>)', '')), '') END AS r"
#: By type: codes, further CTEs, joins to the ports p of instances i, columns.
_PARTS = {
    "lookup": (
        "11",
        f"{_LINES}, wc AS (SELECT mapping_id, instance_id, max(attr_value) AS c FROM attr_rows WHERE attr_name = 'LOOKUP CONDITION' GROUP BY 1, 2), cp AS (SELECT mapping_id, instance_id, row_number() OVER (PARTITION BY mapping_id, instance_id ORDER BY k) AS n, x, regexp_extract(x, '<>|!=|<=|>=|=|<|>') AS o FROM (SELECT mapping_id, instance_id, unnest(range(100)) AS k, trim(unnest(regexp_split_to_array(replace(c, ';', ' AND '), '(?i)\\s+AND\\s+'))) AS x FROM wc) WHERE x <> ''), cs AS (SELECT mapping_id, instance_id, n, {_SIDES} FROM cp)",
        "LEFT JOIN lin ON lin.widget_id = p.widget_id AND lin.field_id = p.field_id LEFT JOIN cs ON cs.mapping_id = i.mapping_id AND cs.instance_id = i.instance_id AND upper(cs.r) = upper(p.field_name)",
        "CAST(lin.line_no AS BIGINT) AS expression_line_no, coalesce(lin.expression, '- N/A -') AS associated_expression, CAST(cs.n AS INTEGER) AS condition_order, cs.l AS lookup_table_column, cs.o AS operator, cs.r AS transformation_port",
    ),
    "joiner": (
        "12",
        f"jc AS (SELECT mapping_id, instance_id, x AS join_condition, {_SIDES} FROM (SELECT mapping_id, instance_id, max(attr_value) AS x, regexp_extract(max(attr_value), '<>|!=|<=|>=|=|<|>') AS o FROM attr_rows WHERE attr_name = 'JOIN CONDITION' AND attr_value IS NOT NULL GROUP BY 1, 2))",
        "LEFT JOIN jc ON jc.mapping_id = i.mapping_id AND jc.instance_id = i.instance_id",
        "CASE WHEN p.porttype & 4 = 4 THEN 'YES' ELSE 'NO' END AS port_m, join_condition, jc.l AS condition_master, jc.o AS condition_operator, jc.r AS condition_detail",
    ),
    "source_qualifier": (
        "3",
        "sq AS (SELECT mapping_id, instance_id, max(attr_value) AS sql_query FROM attr_rows WHERE attr_name = 'SQL QUERY' OR attr_id = 1 GROUP BY 1, 2), sd AS (SELECT mapping_id, to_object_instance_id AS instance_id, string_agg(DISTINCT from_object_name, ', ' ORDER BY from_object_name) AS associated_source_definitions FROM rep_mapping_conn_ports GROUP BY 1, 2)",
        "LEFT JOIN sq ON sq.mapping_id = i.mapping_id AND sq.instance_id = i.instance_id LEFT JOIN sd ON sd.mapping_id = i.mapping_id AND sd.instance_id = i.instance_id",
        "sql_query, associated_source_definitions",
    ),
    "sequence": ("7", "", "", ""),
    "normalizer": (
        "14",
        "np AS (SELECT *, regexp_replace(field_name, '(?i)_in[0-9]*$', '') AS col, CASE WHEN regexp_matches(field_name, '(?i)_in[0-9]*$') THEN 'INPUT_OCCURRENCE' WHEN upper(field_name) LIKE 'GK_%' THEN 'GENERATED_KEY' WHEN upper(field_name) LIKE 'GCID_%' THEN 'GENERATED_COLUMN_ID' ELSE 'OUTPUT' END AS cat FROM opb_widget_field), nc AS (SELECT widget_id, col, count(*) FILTER (cat = 'INPUT_OCCURRENCE') AS n, max(wgt_datatype) FILTER (cat = 'OUTPUT') AS dt, max(wgt_prec) FILTER (cat = 'OUTPUT') AS pr, max(wgt_scale) FILTER (cat = 'OUTPUT') AS sc, min(field_order) FILTER (cat = 'INPUT_OCCURRENCE') AS fo FROM np WHERE cat IN ('INPUT_OCCURRENCE', 'OUTPUT') GROUP BY 1, 2)",
        "JOIN np ON np.widget_id = p.widget_id AND np.field_id = p.field_id LEFT JOIN nc ON nc.widget_id = np.widget_id AND nc.col = np.col",
        "np.col AS normalizer_column_name, np.cat AS normalizer_port_category, CASE WHEN n > 1 THEN n WHEN n IS NOT NULL THEN 0 END AS normalizer_occurs, dt AS normalizer_datatype_code, pr AS normalizer_prec, sc AS normalizer_scale, fo AS normalizer_column_order",
    ),
    "router": (
        "15",
        "rg AS (SELECT object_id AS widget_id, group_id, max(CASE WHEN attr_id = 1 THEN nullif(trim(attr_value), '') END) AS group_name, max(CASE WHEN attr_id = 3 THEN nullif(trim(attr_value), '') END) AS group_filter_condition FROM opb_table_group WHERE object_type = 15 AND attr_id IN (1, 3) GROUP BY 1, 2)",
        "LEFT JOIN rg ON rg.widget_id = p.widget_id",
        "group_id, group_name, group_filter_condition",
    ),
    "aggregator": (
        "9",
        f"{_LINES}, ag AS (SELECT widget_id, field_id, string_agg(expression, ' ' ORDER BY line_no, expr_id) AS expression, bool_or(expr_type = 46) AS g FROM lin GROUP BY 1, 2)",
        "LEFT JOIN ag ON ag.widget_id = p.widget_id AND ag.field_id = p.field_id",
        "ag.expression, CASE WHEN g THEN 'YES' ELSE 'NO' END AS group_by",
    ),
    "custom": (
        "97",
        "gi AS (SELECT DISTINCT mapping_id, to_object_instance_id AS instance_id, to_object_field_name AS field_name, from_object_name AS group_object, CAST(dense_rank() OVER (PARTITION BY mapping_id, to_object_instance_id ORDER BY from_object_name) AS INTEGER) AS group_no FROM rep_mapping_conn_ports)",
        "LEFT JOIN gi ON gi.mapping_id = i.mapping_id AND gi.instance_id = i.instance_id AND gi.field_name = p.field_name",
        "group_object, group_no",
    ),
    "stored_procedure": ("6", "pp AS (SELECT DISTINCT mapping_id, instance_id, attr_name AS property, attr_value AS value FROM attr_rows WHERE attr_name <> 'TRACING LEVEL')", "LEFT JOIN pp ON pp.mapping_id = i.mapping_id AND pp.instance_id = i.instance_id", "pp.property, pp.value"),
    "transaction_control": ("98", "", "", ""),
}


def _sql(name: str) -> str:
    codes, ctes, joins, columns = _PARTS[name]
    return f"""{BASE}, {ATTR_ROWS}, {NEIGHBOURS}, {_EXT}{', ' + ctes if ctes else ''}
SELECT DISTINCT i.workflow_name, i.session_name, i.mapping_name, i.instance_name AS transformation_name, i.widget_type_name AS transformation_type, p.field_order AS port_order, p.field_name AS port_name{', ' + columns if columns else ''}, ext.* EXCLUDE (subject_id, widget_id), previous_transformation, next_transformation
FROM details i JOIN opb_widget_field p ON p.widget_id = i.widget_id {joins} LEFT JOIN ext ON ext.subject_id = i.subject_id AND ext.widget_id = i.widget_id LEFT JOIN conn ON conn.subject_id = i.subject_id AND conn.mapping_id = i.mapping_id AND conn.instance_id = i.instance_id AND conn.field_name = p.field_name WHERE i.widget_type IN ({codes})"""


ORACLE = {shown: _sql(name) for name, shown in _NAMES.items()}
