"""Repository tables projected from the star schema, as SQL that Spark and DuckDB both run.

Region = subject area, nation = workflow, customer = session and mapping, order = transformation
instance, line = port; consecutive orders of a customer are connected on equal line numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .store import written

#: Bytes of rows in memory for a byte of a written table: names and types repeat, so that Parquet keeps them in a tenth or less.
MEMORY_FACTOR = "16"
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: (widget type, attribute id, attribute name, kind of value). Names are those of the ETL repository (fixed values).
ATTRIBUTES = [
    (3, 1, "Sql Query", "sql"), (3, 2, "User Defined Join", "cond"), (3, 3, "Source Filter", "cond"), (3, 4, "Number Of Sorted Ports", "code"), (3, 5, "Tracing Level", "code"), (3, 6, "Select Distinct", "bool"), (3, 7, "Pre SQL", "text"), (3, 8, "Post SQL", "text"), (3, 9, "Output is deterministic", "bool"), (3, 10, "Output is repeatable", "bool"),
    (5, 1, "Tracing Level", "code"),
    (6, 1, "Stored Procedure Name", "text"), (6, 2, "Connection Information", "text"), (6, 3, "Tracing Level", "code"), (6, 4, "Call Text", "text"),
    (7, 1, "Start Value", "code"), (7, 2, "Increment By", "code"), (7, 3, "End Value", "text"), (7, 4, "Current Value", "code"), (7, 5, "Cycle", "bool"), (7, 6, "Number of Cached Values", "code"), (7, 7, "Reset", "bool"), (7, 8, "Tracing Level", "code"),
    (9, 1, "Cache Directory", "text"), (9, 2, "Tracing Level", "code"), (9, 3, "Sorted Input", "bool"), (9, 4, "Aggregator Data Cache Size", "text"), (9, 5, "Aggregator Index Cache Size", "text"), (9, 6, "Transformation Scope", "code"),
    (11, 1, "Lookup Sql Override", "sql"), (11, 2, "Lookup table name", "text"), (11, 3, "Lookup Source Filter", "cond"), (11, 4, "Lookup caching enabled", "bool"), (11, 5, "Lookup policy on multiple match", "text"), (11, 6, "Lookup condition", "conds"), (11, 7, "Connection Information", "text"), (11, 8, "Source Type", "text"), (11, 9, "Tracing Level", "code"), (11, 10, "Dynamic Lookup Cache", "bool"), (11, 11, "Sorted Input", "bool"), (11, 12, "Cache File Name Prefix", "text"),
    (12, 1, "Cache Directory", "text"), (12, 2, "Join Condition", "cond"), (12, 3, "Join Type", "code"), (12, 4, "Null ordering in master", "code"), (12, 5, "Null ordering in detail", "code"), (12, 6, "Tracing Level", "code"), (12, 7, "Joiner Data Cache Size", "text"), (12, 8, "Joiner Index Cache Size", "text"), (12, 9, "Sorted Input", "bool"), (12, 10, "Master Sort Order", "text"), (12, 11, "Transformation Scope", "code"),
    (13, 1, "Filter Condition", "cond"), (13, 2, "Tracing Level", "code"),
    (14, 1, "Reset", "bool"), (14, 2, "Restart", "bool"), (14, 3, "Tracing Level", "code"),
    (15, 1, "Tracing Level", "code"),
    (16, 1, "Update Strategy Expression", "cond"), (16, 2, "Forward Rejected Rows", "bool"), (16, 3, "Tracing Level", "code"),
    (80, 1, "Sorter Cache Size", "text"), (80, 2, "Case Sensitive", "bool"), (80, 3, "Work Directory", "text"), (80, 4, "Distinct", "bool"), (80, 5, "Tracing Level", "code"), (80, 6, "Null Treated Low", "bool"), (80, 7, "Transformation Scope", "code"),
    (97, 1, "Language", "text"), (97, 2, "Module Identifier", "text"), (97, 3, "Function Identifier", "text"), (97, 4, "Runtime Location", "text"), (97, 5, "Tracing Level", "code"), (97, 6, "Is Partitionable", "bool"), (97, 7, "Is Active", "bool"), (97, 8, "Transformation Scope", "code"), (97, 9, "Generate Transaction", "bool"),
    (98, 1, "Transaction Control Condition", "cond"), (98, 2, "Tracing Level", "code"),
    (1, 1, "Owner Name", "text"), (1, 2, "Source Table Name", "text"), (1, 3, "Source Timestamp", "text"),
    (2, 1, "Reject Truncated/Overflowed Rows", "bool"), (2, 2, "Update Override", "sql"), (2, 3, "Table Name Prefix", "text"), (2, 4, "Pre SQL", "text"), (2, 5, "Post SQL", "text"), (2, 6, "Target Table Name", "text"),
]

TYPE_NAMES = {1: "Source Definition", 2: "Target Definition", 3: "Source Qualifier", 5: "Expression", 6: "Stored Procedure", 7: "Sequence", 9: "Aggregator", 11: "Lookup Procedure", 12: "Joiner", 13: "Filter", 14: "Normalizer", 15: "Router", 16: "Update Strategy", 44: "Mapplet", 80: "Sorter", 97: "Custom Transformation", 98: "Transaction Control"}

_attr = ", ".join(f"({w}, {i}, '{n}', '{k}')" for w, i, n, k in ATTRIBUTES)
_type = " ".join(f"WHEN {k} THEN '{v}'" for k, v in TYPE_NAMES.items())
_cond = "concat('F', CAST(1 + w.widget_id % 7 AS VARCHAR(20)), CASE w.widget_id % 5 WHEN 0 THEN ' = ' WHEN 1 THEN ' >= ' WHEN 2 THEN '<>' WHEN 3 THEN ' < ' ELSE ' ' END, 'F', CAST(1 + w.widget_id % 3 AS VARCHAR(20)))"

#: CTEs by name, in order.
TABLES = {
    "rep_workflows": "SELECT r.r_name AS subject_area, CAST(n.n_regionkey AS BIGINT) AS subject_id, CAST(n.n_nationkey AS BIGINT) AS workflow_id, concat('WF_', n.n_name) AS workflow_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey",
    "rep_task_inst": "SELECT CAST(c_nationkey AS BIGINT) AS workflow_id, c_custkey AS task_id, CASE WHEN c_custkey % 10 = 0 THEN 62 ELSE 68 END AS task_type, concat('s_', CAST(c_custkey AS VARCHAR(20))) AS instance_name FROM customer",
    "rep_load_sessions": "SELECT c.c_custkey AS session_id, concat('S_', CAST(c.c_custkey AS VARCHAR(20))) AS session_name, c.c_custkey AS mapping_id, w.subject_area, w.subject_id FROM customer c JOIN rep_workflows w ON w.workflow_id = c.c_nationkey",
    "rep_all_mappings": "SELECT mapping_id, concat('m_', CAST(mapping_id AS VARCHAR(20))) AS mapping_name, subject_area, subject_id FROM rep_load_sessions",
    "inst_rank": "SELECT o_custkey AS mapping_id, o_orderkey AS instance_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    "rep_widget_inst": "SELECT j.*, CASE j.widget_type " + _type + " END AS widget_type_name FROM (SELECT i.mapping_id, m.subject_id, i.instance_id, concat('INST_', CAST(i.instance_id AS VARCHAR(20))) AS instance_name, i.instance_id AS widget_id, CASE WHEN i.rn = 1 THEN 1 WHEN i.rn = i.n THEN 2 ELSE i.mid_type END AS widget_type, 1 AS version_number, i.rn, i.n FROM (SELECT *, CASE instance_id % 16 WHEN 0 THEN 5 WHEN 1 THEN 11 WHEN 2 THEN 12 WHEN 3 THEN 3 WHEN 4 THEN 80 WHEN 5 THEN 9 WHEN 6 THEN 15 WHEN 7 THEN 44 WHEN 8 THEN 13 WHEN 9 THEN 14 WHEN 10 THEN 16 WHEN 11 THEN 7 WHEN 12 THEN 97 WHEN 13 THEN 6 WHEN 14 THEN 98 ELSE 5 END AS mid_type FROM inst_rank) i JOIN rep_all_mappings m ON m.mapping_id = i.mapping_id) j",
    "opb_widget_field": "SELECT l_orderkey AS widget_id, 1 AS version_number, l_linenumber AS field_id, l_linenumber AS field_order, CASE WHEN l_orderkey % 16 = 9 THEN CASE l_linenumber % 4 WHEN 0 THEN concat('GK_C', CAST(l_linenumber AS VARCHAR(20))) WHEN 3 THEN CASE WHEN l_linenumber = 3 THEN 'C' ELSE concat('C', CAST(l_linenumber AS VARCHAR(20))) END WHEN 1 THEN concat('C_in', CAST(l_linenumber AS VARCHAR(20))) ELSE concat('C_IN', CAST(l_linenumber AS VARCHAR(20))) END ELSE concat('F', CAST(l_linenumber AS VARCHAR(20))) END AS field_name, CAST(min(l_quantity) AS INT) % 24 - 5 AS wgt_datatype, 10 * l_linenumber AS wgt_prec, l_linenumber % 3 AS wgt_scale, CASE CAST(max(l_quantity) AS INT) % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 32 WHEN 4 THEN 7 WHEN 5 THEN 10 ELSE 3 END AS porttype, l_linenumber % 4 AS property, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "port": "SELECT w.mapping_id, w.subject_id, w.instance_id, w.instance_name, w.rn, w.n, w.widget_type, f.field_id, f.field_name FROM rep_widget_inst w JOIN opb_widget_field f ON f.widget_id = w.widget_id",
    "rep_mapping_conn_ports": "SELECT a.subject_id, a.mapping_id, 1 AS mapping_version_number, a.instance_id AS from_object_instance_id, a.instance_name AS from_object_name, a.field_name AS from_object_field_name, b.instance_id AS to_object_instance_id, b.instance_name AS to_object_name, b.field_name AS to_object_field_name FROM port a JOIN port b ON a.mapping_id = b.mapping_id AND a.field_id = b.field_id AND (b.rn = a.rn + 1 OR (b.rn = a.rn + 2 AND a.instance_id % 7 = 0))",
    "attr_spec": f"SELECT * FROM (VALUES {_attr}) AS t(wt, attr_id, attr_name, kind)",
    "rep_widget_attr": "SELECT w.widget_id, 1 AS version_number, CASE w.widget_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE w.mapping_id END AS mapping_id, CASE w.widget_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE w.instance_id END AS instance_id, CASE WHEN w.widget_id % 5 = 0 THEN NULL ELSE w.widget_type END AS widget_type, s.attr_id, s.attr_name, CASE WHEN (w.widget_id + s.attr_id) % 11 = 0 THEN '  ' ELSE CASE s.kind WHEN 'cond' THEN " + _cond + " WHEN 'conds' THEN concat(" + _cond + ", CASE w.widget_id % 3 WHEN 0 THEN '; F2 = F1' WHEN 1 THEN '  and  F3 != F2' ELSE '' END) WHEN 'sql' THEN concat('SELECT A.F1, B.F2 AS X FROM TAB_', CAST(w.widget_id % 50 AS VARCHAR(20)), ' A JOIN OWN.TAB_', CAST(w.widget_id % 30 AS VARCHAR(20)), ' B ON A.ID = B.ID WHERE A.F1 > 10 ORDER BY 1') WHEN 'code' THEN CAST((w.widget_id + s.attr_id) % 6 AS VARCHAR(20)) WHEN 'bool' THEN CASE (w.widget_id + s.attr_id) % 7 WHEN 0 THEN 'YES' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'True' WHEN 5 THEN 'odd' ELSE 'FALSE' END ELSE concat(' v', CAST(s.attr_id AS VARCHAR(20)), '_', CAST(w.widget_id % 100 AS VARCHAR(20)), ' ') END END AS attr_value, 1 AS line_no FROM rep_widget_inst w JOIN attr_spec s ON s.wt = w.widget_type",
    "opb_widget_expr": "SELECT widget_id, version_number, field_id AS output_field_id, field_id + 100 AS expr_id, CASE WHEN flag = 'R' THEN 46 ELSE 1 END AS expr_type FROM opb_widget_field WHERE flag <> 'N' OR status = 'F'",
    "opb_expression": "SELECT e.widget_id, e.version_number, e.expr_id, l.line_no, CASE l.line_no WHEN 1 THEN concat('IIF(F', CAST(1 + e.widget_id % 4 AS VARCHAR(20)), ' > 0,') WHEN 2 THEN concat('F', CAST(e.output_field_id AS VARCHAR(20)), ', 0)') ELSE '-- end' END AS expression FROM opb_widget_expr e JOIN (VALUES (1), (2), (3)) AS l(line_no) ON l.line_no <= 2 + e.widget_id % 2",
    "opb_table_group": "SELECT w.widget_id AS object_id, 1 AS version_number, CASE WHEN w.widget_id % 9 = 0 THEN 14 ELSE 15 END AS object_type, g.group_id, a.attr_id, CASE WHEN a.attr_id = 1 THEN concat(' GRP', CAST(g.group_id AS VARCHAR(20))) WHEN a.attr_id = 3 THEN concat('F', CAST(g.group_id AS VARCHAR(20)), ' > 0') ELSE 'x' END AS attr_value FROM rep_widget_inst w JOIN (VALUES (1), (2), (3)) AS g(group_id) ON g.group_id <= 1 + w.widget_id % 3 JOIN (VALUES (1), (2), (3)) AS a(attr_id) ON 1 = 1 WHERE w.widget_type = 15",
    "rep_metadata_extns": "SELECT w.subject_id, w.widget_id AS metadata_extn_object_id, 1 AS version_number, concat('EXT_', CAST(x.k AS VARCHAR(20))) AS metadata_extn_name, CASE WHEN w.widget_id % 4 = 0 THEN NULL ELSE CAST(w.widget_id % 5 AS INT) END AS metadata_extn_data_type, concat('val', CAST(w.widget_id AS VARCHAR(20))) AS metadata_extn_value, CAST(x.k AS INT) AS permissions, x.k AS line_no, CASE WHEN w.widget_id % 2 = 0 THEN w.widget_id END AS domain_id, CASE WHEN w.widget_id % 2 = 0 THEN 'DOM' END AS domain_name, 1 AS domain_usage, 'descr' AS metadata_extn_description FROM rep_widget_inst w JOIN (VALUES (1), (2)) AS x(k) ON w.widget_id % 5 < x.k",
    "inst_table": "SELECT w.mapping_id, w.instance_id, w.instance_name, w.widget_type, concat('TAB_', CAST(w.instance_id % 300 AS VARCHAR(20))) AS table_name FROM rep_widget_inst w WHERE w.widget_type IN (1, 2)",
    "task": "SELECT workflow_id, task_id, instance_name AS task_name, CASE WHEN task_type = 68 THEN instance_name END AS session_name, row_number() OVER (PARTITION BY workflow_id ORDER BY task_id) AS ord FROM rep_task_inst",
    "workflow_link": "SELECT t.workflow_id, CASE WHEN t.ord = 1 THEN 'Start' ELSE p.task_name END AS from_task, t.task_name AS to_task, CASE WHEN t.ord % 4 = 0 THEN concat('$', t.task_name, '.Status = SUCCEEDED') END AS condition, 2 * t.ord AS ord FROM task t LEFT JOIN task p ON p.workflow_id = t.workflow_id AND p.ord = CASE WHEN t.ord % 2 = 0 THEN t.ord ELSE t.ord - 1 END / 2 WHERE t.ord % 13 <> 12 UNION ALL SELECT a.workflow_id, a.task_name, b.task_name, NULL, 2 * a.ord + 1 FROM task a JOIN task b ON a.workflow_id = b.workflow_id AND b.ord = a.ord + 3 WHERE a.ord % 5 = 0",
}


_x_type = "CASE WHEN w.widget_type = 98 AND w.instance_id % 2 = 0 THEN 'SQL' WHEN w.widget_type = 6 AND w.instance_id % 2 = 1 THEN 'Rank' ELSE w.widget_type_name END"
_x_own = "concat('F', CAST(f.field_id AS VARCHAR(20)))"
_x_other = "concat('F', CAST(1 + (f.field_id + 1) % 4 AS VARCHAR(20)))"

#: The tables of an export, with more shapes than the repository: suffixed routers and joiners, union groups, generated and return ports, lower-case fields.
TABLES |= {
    "x_inst": f"SELECT w.mapping_id, w.subject_id, CASE WHEN w.widget_type IN (12, 15) AND w.instance_id % 3 = 0 THEN concat(w.instance_name, '.G1') ELSE w.instance_name END AS instance, w.instance_name AS base, CASE WHEN w.widget_type IN (1, 2) THEN concat('TAB_', CAST(w.instance_id % 300 AS VARCHAR(20))) WHEN w.instance_id % 10 = 0 THEN concat('RX_', CAST(w.instance_id % 40 AS VARCHAR(20))) ELSE w.instance_name END AS definition, {_x_type} AS type, CASE WHEN w.widget_type = 97 AND w.instance_id % 3 <> 0 THEN 'Union Transformation' END AS template, w.instance_id, w.rn AS ord FROM rep_widget_inst w",
    "x_port": f"SELECT i.mapping_id, i.instance, i.type, i.template, f.field_name AS field, f.field_id AS ord, CASE WHEN i.type = 'Aggregator' AND f.field_id % 3 = 1 THEN 'INPUT/OUTPUT/GROUPBY' WHEN i.type = 'Sorter' AND f.field_id % 3 = 1 THEN 'INPUT/OUTPUT/SORTKEY' WHEN i.type = 'Rank' AND f.field_id % 3 = 1 THEN 'INPUT/OUTPUT/KEY' ELSE CASE f.porttype WHEN 1 THEN 'INPUT' WHEN 2 THEN 'OUTPUT' WHEN 32 THEN 'LOCAL VARIABLE' WHEN 7 THEN 'LOOKUP/OUTPUT' WHEN 10 THEN 'RETURN' ELSE 'INPUT/OUTPUT' END END AS porttype, CASE f.field_id % 4 WHEN 0 THEN 'DESCENDING' WHEN 1 THEN 'ASCENDING' END AS sort_order, CASE WHEN f.field_id % 3 = 0 THEN 'G1' WHEN f.field_id % 3 = 1 THEN 'G2' ELSE 'OUTPUT' END AS grp, CASE WHEN i.type IN ('Source Definition', 'Target Definition') THEN NULL ELSE CASE (i.instance_id * 3 + f.field_id) % 13 WHEN 1 THEN {_x_other} WHEN 2 THEN concat('IIF(F1 > 0, ', {_x_other}, ', 0)') WHEN 3 THEN concat('F1 || ', {_x_other}) WHEN 4 THEN 'LKP:INST_9(F1)' WHEN 5 THEN 'DECODE(F1, 1, ''F2'')' WHEN 6 THEN concat({_x_own}, ' = ', {_x_other}) WHEN 7 THEN 'SYSDATE' WHEN 8 THEN concat('LTRIM(', {_x_other}, ')') WHEN 9 THEN 'TO_CHAR(f1)' WHEN 10 THEN 'NEXTVAL' WHEN 11 THEN 'F1 + COUNT' END END AS expression FROM x_inst i JOIN opb_widget_field f ON f.widget_id = i.instance_id",
    "x_attr": "SELECT i.mapping_id, i.instance, i.type, a.attr_name AS name, max(trim(a.attr_value)) AS value FROM rep_widget_attr a JOIN x_inst i ON i.instance_id = a.widget_id WHERE trim(a.attr_value) <> '' AND i.type <> 'SQL' GROUP BY i.mapping_id, i.instance, i.type, a.attr_name UNION ALL SELECT mapping_id, instance, type, 'Sql Query', concat('SELECT X.F1 + 1 AS F4, Y.F2 FROM X, Y WHERE X.A = :F1 AND Y.B = :f', CAST(1 + instance_id % 3 AS VARCHAR(20))) FROM x_inst WHERE type = 'SQL'",
    "x_conn": "SELECT c.mapping_id, a.instance AS from_inst, CASE WHEN a.instance_id % 11 = 0 THEN lower(c.from_object_field_name) ELSE c.from_object_field_name END AS from_field, CASE WHEN b.template IS NOT NULL AND a.instance_id % 4 <> 0 THEN concat(b.instance, '.IN', CAST(a.instance_id % 2 AS VARCHAR(20))) ELSE b.base END AS to_inst, CASE WHEN b.template IS NOT NULL AND a.instance_id % 3 = 0 THEN lower(c.to_object_field_name) ELSE c.to_object_field_name END AS to_field FROM rep_mapping_conn_ports c JOIN x_inst a ON a.mapping_id = c.mapping_id AND a.instance_id = c.from_object_instance_id JOIN x_inst b ON b.mapping_id = c.mapping_id AND b.instance_id = c.to_object_instance_id",
    "x_target_field": "SELECT DISTINCT i.definition, f.field_name AS field FROM x_inst i JOIN opb_widget_field f ON f.widget_id = i.instance_id WHERE i.type = 'Target Definition' AND i.instance_id % 5 <> 0",
    "x_load_order": "SELECT mapping_id, instance AS target_instance, CASE WHEN instance_id % 7 = 0 THEN 'x' ELSE CAST(instance_id % 4 AS VARCHAR(20)) END AS ord FROM x_inst WHERE type = 'Target Definition' AND instance_id % 3 <> 0 UNION ALL SELECT mapping_id, 'GONE', '9' FROM rep_all_mappings WHERE mapping_id % 6 = 0",
    "x_session": "SELECT c_custkey AS ord, CAST(c_nationkey AS BIGINT) AS workflow_id, concat('S_', CAST(c_custkey % 1000 AS VARCHAR(20))) AS session_name, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE concat('m_', CAST(c_custkey AS VARCHAR(20))) END AS mapping_name FROM customer",
    "x_task": "SELECT workflow_id, ord, CASE WHEN ord % 9 = 0 THEN '' ELSE concat('t_', session_name) END AS name, CASE WHEN ord % 8 = 0 THEN '' ELSE session_name END AS task_name, CASE WHEN ord % 10 = 0 THEN 'Command' ELSE 'Session' END AS task_type, CASE WHEN ord % 12 = 0 THEN 'NO' WHEN ord % 5 = 0 THEN NULL ELSE 'YES' END AS isenabled FROM x_session",
    "x_link": "SELECT a.workflow_id, a.ord, CASE WHEN a.n = 1 AND a.workflow_id % 4 <> 0 THEN 'Start' ELSE p.name END AS from_task, a.name AS to_task, CASE WHEN a.ord % 4 = 0 THEN concat('$', a.name, '.Status = SUCCEEDED') END AS condition FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY ord) AS n FROM x_task) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY ord) AS n FROM x_task) p ON p.workflow_id = a.workflow_id AND p.n = a.n - 1 - a.n % 2 WHERE a.ord % 13 <> 12",
    "x_extension": "SELECT s.session_name, concat('TGT_', CAST(s.ord % 90 AS VARCHAR(20))) AS instance, CASE WHEN s.ord % 3 = 0 THEN 'READER' ELSE 'WRITER' END AS type, CASE WHEN s.ord % 2 = 0 THEN 'File Writer' ELSE 'Relational Writer' END AS subtype, s.ord, a.name, CASE WHEN (s.ord + a.k) % 4 = 0 THEN '' ELSE concat('/out/', a.name, CAST(s.ord AS VARCHAR(20))) END AS value FROM x_session s JOIN (VALUES (1, 'Output filename'), (2, 'Output file directory'), (3, 'Header')) AS a(k, name) ON 1 = 1",
}

_n_task = "(SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY ord) AS n FROM x_task)"

#: SQL texts by shape: quotes, brackets, comments, subqueries, common table expressions, branches, no query at all.
SHAPES = [
    "SELECT A.F1, B.F2 AS X FROM TAB_{n} A JOIN OWN.TAB_B B ON A.ID = B.ID WHERE A.F1 > 10 ORDER BY 1",
    "select distinct \"Own\".\"Tab {n}\".\"Col A\" as \"Out\", NVL(t.b, 'x, y') y from \"Own\".\"Tab {n}\" t where t.b <> ')' and t.c in (1, 2)",
    "SELECT (SELECT MAX(Z.V) FROM TAB_Z Z WHERE Z.ID = A.ID) MAXV, A.ID FROM TAB_{n} A",
    "WITH C AS (SELECT ID, V FROM TAB_{n} WHERE V > 0) SELECT C.ID, C.V FROM C JOIN [dbo].[Tab Two] T ON T.ID = C.ID",
    "SELECT A FROM TAB_{n} WHERE A = 1 UNION ALL SELECT B FROM OTHER@LINK WHERE B = 2 GROUP BY B",
    "SELECT A -- first, not B\n, /* C, */ D FROM TAB_{n} /* WHERE X */ WHERE D = '--no'",
    "SELECT EXTRACT(DAY FROM D) AS DY, CASE WHEN A IN (1, 2) THEN 'a,b' ELSE 'c' END K FROM TAB_{n}",
    "SELECT COUNT(*) CNT FROM (SELECT X.A FROM TAB_{n} X WHERE X.A IS NOT NULL) S WHERE S.A > 5 HAVING COUNT(*) > 1",
    "SELECT * FROM DUAL",
    "update T set A = 1 where B = 2",
    "SELECT a.b.c.D, E + 1 FROM s.TAB_{n}, U WHERE D = F.E(+) AND N = 1.5;",
    "SELECT 'it''s' AS Q, \"x\"\"y\" FROM TAB_{n} WHERE Q LIKE '%WHERE%'",
    " ",
]
_shapes = ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(SHAPES))

#: Links with diamonds, cycles and repeated ends, each with a place of its own, and connectors whose document order isn't that of the data flow.
TABLES |= {
    "y_link": f"SELECT workflow_id, 4 * ord AS ord, from_task, to_task, condition FROM x_link UNION ALL SELECT a.workflow_id, 4 * a.ord + k.k, a.name, b.name, CASE WHEN k.k = 3 THEN concat('$', a.name, '.Rows > 0') END FROM {_n_task} a JOIN (VALUES (1), (2), (3)) AS k(k) ON (k.k = 1 AND a.ord % 5 = 0) OR (k.k = 2 AND a.ord % 29 = 0) OR (k.k = 3 AND a.ord % 6 = 0) JOIN {_n_task} b ON b.workflow_id = a.workflow_id AND b.n = a.n + CASE k.k WHEN 1 THEN 5 WHEN 2 THEN -3 ELSE 1 END",
    "y_conn": "SELECT mapping_id, from_inst, from_field, to_inst, to_field, row_number() OVER (PARTITION BY mapping_id ORDER BY md5(concat(from_inst, '|', to_inst)), from_inst, to_inst, from_field, to_field) AS ord FROM x_conn",
    "y_inst": "SELECT mapping_id, subject_id, instance, base, CASE WHEN type = 'Source Definition' AND instance_id % 3 = 0 THEN concat('RAW_', CAST(instance_id % 50 AS VARCHAR(20))) WHEN type = 'Target Definition' AND instance_id % 4 = 0 THEN concat('OUT_', CAST(instance_id % 60 AS VARCHAR(20))) ELSE definition END AS definition, type, template, instance_id, ord FROM x_inst",
    "y_inst_table": "SELECT mapping_id, instance_id, CASE WHEN type = 'Source Definition' THEN 1 ELSE 2 END AS widget_type, definition AS table_name FROM y_inst WHERE type IN ('Source Definition', 'Target Definition')",
    "y_sql": f"SELECT w.mapping_id, w.instance_id, s.shape, replace(s.text, '{{n}}', CAST(w.instance_id % 50 AS VARCHAR(20))) AS sql FROM rep_widget_inst w LEFT JOIN (VALUES {_shapes}) AS s(shape, text) ON s.shape = w.instance_id % 14 WHERE w.widget_type NOT IN (1, 2)",
    "y_definition": "SELECT mapping_id, definition AS transformation, 100 - min(ord) AS ord FROM x_inst WHERE type NOT IN ('Source Definition', 'Target Definition') GROUP BY mapping_id, definition UNION ALL SELECT mapping_id, concat('LONE_', CAST(mapping_id % 5 AS VARCHAR(20))), 101 FROM rep_all_mappings WHERE mapping_id % 3 = 0",
}


def with_sql(last: str | None = None) -> str:
    """The CTEs up to `last` as the beginning of a WITH clause."""
    names = list(TABLES)
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in names[: names.index(last) + 1 if last else None])


class Repository(dict):
    """Repository tables by name; each is projected, with those it needs, when it is first asked for.

    A table is written once for a session and folder, so that the queries that use it read the same files instead of
    projecting it anew. The projection runs in a session of its own: the caller's temporary views stay as they are.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir, self.own = spark, sf_dir, spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            self.own.conf.set(key, spark.conf.get(key))
        sized_by_rows(self.own)

    def __missing__(self, name: str) -> DataFrame:
        for other in dict.fromkeys(re.findall(r"\w+", TABLES[name])):
            if other in STAR and not self.own.catalog.tableExists(other):
                self.own.read.parquet(f"{self.sf_dir}/{other}.parquet").createOrReplaceTempView(other)
            elif other in TABLES and other != name:
                self[other]
        made = self.own.sql(TABLES[name])
        path = written(made, name)
        self.own.read.schema(made.schema).parquet(path).createOrReplaceTempView(name)
        self[name] = self.spark.read.schema(made.schema).parquet(path)
        return self[name]


_held: dict[tuple[str, str], Repository] = {}


def sized_by_rows(spark: SparkSession) -> None:
    """Lets the planner judge a table by its rows in memory, not by its compressed files, before it gathers the table on the driver for a broadcast. A factor that the user has set stays."""
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) == 1:
        spark.conf.set(key, MEMORY_FACTOR)


def repository(spark: SparkSession, sf_dir: str) -> Repository:
    sized_by_rows(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _held:
        _held[key] = Repository(spark, sf_dir)
    _held[key].spark = spark
    return _held[key]
