"""Queries of records, definitions, detail sheets, mapplets and sequences, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import blocks, details, inventory, lineage, overview
from metaloom.sources import records, sinks, xml_export
from metaloom.sources.fixture import repository, with_sql
from metaloom.sources.store import keeps_texts_once, shared_folder

from .lineage import ORACLE as _LINEAGE
from .metadata import ATTR_ROWS, BASE, KEYS


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rows(spark, d):
    repo = repository(spark, d)
    return repo, blocks.attr_rows(blocks.relevant(inventory.all_details(repo)), repo["rep_widget_attr"])


def a06(spark, d):
    """Event properties as canonical trees, half of them below `root`."""
    tree = "to_json(named_struct('tag', event_type, 'attributes', map('user', cast(user_id as string)), 'children', array(named_struct('tag', 'props', 'text', props), named_struct('tag', 'leaf', 'text', cast(null as string)))))"
    texts = _read(spark, d, "events").selectExpr("event_id", f"CASE WHEN event_id % 2 = 0 THEN concat('{{\"root\":', {tree}, '}}') ELSE {tree} END AS text")
    got = records.canonical_nodes(texts, "event_id", "text")
    return got.select(F.col("doc").alias("event_id"), F.array_join("path", ".").alias("path"), "tag", F.col("attributes")["user"].alias("user_name"), "text")


def a09(spark, d):
    rows = _read(spark, d, "conversations").selectExpr("conv_id", "turn", "CASE WHEN turn % 2 = 0 THEN '  ' WHEN turn % 3 = 0 THEN NULL ELSE role END AS a", "CASE WHEN conv_id % 3 = 0 THEN '' ELSE text END AS b")
    return records.drop_blank_rows(rows, ["a", "b"], True)


def a10(spark, d):
    rows = _read(spark, d, "conversations").selectExpr("conv_id", "turn", "posexplode(split(text, ' ')) AS (pos, name)").withColumn("sheet", F.concat_ws("-", "conv_id", "turn"))
    return xml_export.unique_headers(rows.select("sheet", "pos", F.when(F.col("pos") % 4 == 3, "").otherwise(F.lower("name")).alias("name")))


def a11(spark, d):
    cells = _read(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("cells"))
    row = records.align_rows(F.col("cells"), 6)
    return cells.select("conv_id", "turn", *[row[k].alias(f"c{k}") for k in range(6)])


def _orders(spark, d):
    rows = _read(spark, d, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_custkey % 3 <> 0 THEN o_orderstatus END AS status", "o_orderdate AS ordered", "cast(o_totalprice AS decimal(12, 2)) AS price")
    return records.json_safe(rows)


def a12(spark, d):
    rows = _orders(spark, d)
    return rows.select("id", records.json_records(rows).alias("record"))


def a13(spark, d):
    rows, path = _orders(spark, d), f"{shared_folder(spark)}/jsonl-{d.strip('/').replace('/', '-')}"
    records.write_jsonl(rows, F.lit("orders"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def a14(spark, d):
    return _orders(spark, d)


def a15(spark, d):
    """Instances written by type, in their order, and read back; each folder holds what the manifest says."""
    rows = repository(spark, d)["rep_widget_inst"].select("widget_type", "mapping_id", "instance_id", "instance_name")
    path = f"{shared_folder(spark)}/instances-{d.strip('/').replace('/', '-')}"
    sinks.write_ordered(rows, path, ["widget_type"], ["mapping_id", "instance_id"])
    back = sinks.read_ordered(spark, path, "widget_type int, mapping_id long, instance_id long, instance_name string")
    return back.join(sinks.checked(back, path, ["widget_type"]).select("widget_type", "rows", "whole"), "widget_type")


def a19(spark, d):
    paths = _read(spark, d, "pages").select(F.col("page_id").alias("pos"), F.concat(F.regexp_extract("url", "^https?://([^/]+)/", 1), F.lit("/f"), (F.col("page_id") % 7).cast("string"), F.when(F.col("page_id") % 2 == 0, ".JSON").otherwise(".xml")).alias("path"))
    return records.resolve_inputs(paths, ("json",))


def d02d(spark, d):
    repo, rows = _rows(spark, d)
    return details.lookup_port_conditions(rows, repo["opb_widget_field"])


def d03b(spark, d):
    return details.lookup_override(_rows(spark, d)[1])


def d05b(spark, d):
    return details.qualifier_sql(_rows(spark, d)[1])


def f03(spark, d):
    inst = repository(spark, d)["x_inst"]
    folder = inst.groupBy("subject_id", F.col("definition").alias("name")).agg(F.min("type").alias("type"))
    local = inst.where("type = 'Target Definition'").groupBy("mapping_id", F.col("definition").alias("name")).agg(F.max("type").alias("type"))
    return details.resolve_definitions(folder, local, inst.select("subject_id", "mapping_id", F.col("definition").alias("name")))


def f44(spark, d):
    keeps_texts_once(spark)
    inst = repository(spark, d)["x_inst"].selectExpr("concat('S_', mapping_id) AS session_name", "concat('m_', mapping_id) AS mapping_name", "definition AS name", "instance_id", "mapping_id")
    rows = inst.selectExpr("CASE WHEN instance_id % 3 = 0 THEN session_name END AS session_name", "CASE WHEN instance_id % 3 <> 2 THEN upper(mapping_name) END AS mapping_name", "concat(' ', lower(name)) AS name", "concat('t', instance_id) AS text")
    return details.detail_match(inst.select("session_name", "mapping_name", "name").distinct(), rows)


def f45(spark, d):
    repo = repository(spark, d)
    ports = repo["x_port"].select("mapping_id", "instance", F.col("field").alias("port"), F.col("expression").alias("text"))
    other = repo["x_attr"].where("lower(name) like '%condition%'").select("mapping_id", "instance", F.lit(None).cast("string").alias("port"), F.col("value").alias("text"))
    return details.logic_text(ports.unionByName(other), ["mapping_id", "instance"])


def f46(spark, d):
    repo = repository(spark, d)
    return details.resolve_mapping(repo["x_session"], repo["rep_all_mappings"])


def f48(spark, d):
    repo = repository(spark, d)
    return details.ordered_rows(repo["x_port"].select("mapping_id", "instance", "field").join(repo["x_inst"].select("mapping_id", "instance", F.col("ord").alias("inst_ord")), ["mapping_id", "instance"]))


def i02(spark, d):
    repo = repository(spark, d)
    edge, port = lineage.edges(repo["rep_mapping_conn_ports"]), lineage.ports(repo)
    return details.logic_by_hop(lineage.paths(edge, port), port.select("mapping_id", "node", "expression"))


def i04(spark, d):
    repo = repository(spark, d)
    own = repo["x_inst"].where("type = 'Mapplet'").selectExpr("mapping_id", "instance", "concat('MP_', instance_id % 3) AS definition")
    fields = spark.range(1, 8).selectExpr("concat('F', id) AS f")
    inner = spark.createDataFrame([("MP_0", "IN", "NESTED"), ("MP_0", "NESTED", "OUT"), ("MP_1", "IN", "EXP_A"), ("MP_1", "EXP_A", "OUT"), ("MP_2", "IN", "EXP_A"), ("MP_2", "EXP_A", "EXP_B"), ("MP_2", "EXP_B", "OUT")], "definition string, from_inst string, to_inst string")
    inner = inner.crossJoin(F.broadcast(fields)).selectExpr("definition", "from_inst", "f AS from_field", "to_inst", "f AS to_field")
    nested = spark.createDataFrame([("MP_0", "NESTED", "MP_1")], "definition string, instance string, inner_definition string")
    return details.expand_mapplets(repo["x_conn"], own, inner, nested)


def j05(spark, d):
    return overview.numbered(_read(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.col("n").cast("long").alias("sequence_no"))


QUERIES = {
    "a06_canonical_nodes": a06, "a09_drop_blank_rows": a09, "a10_unique_headers": a10, "a11_align_rows": a11, "a12_json_records": a12, "a13_jsonl": a13, "a14_json_safe": a14, "a15_written_instances": a15, "a19_resolve_inputs": a19, "d02d_lookup_port_conditions": d02d, "d03b_lookup_override": d03b, "d05b_qualifier_sql": d05b,
    "f03_resolve_definitions": f03, "f44_detail_match": f44, "f45_logic_text": f45, "f46_resolve_mapping": f46, "f48_ordered_rows": f48, "i02_logic_by_hop": i02, "i04_expand_mapplets": i04, "j05_sequence": j05,
}

_S = with_sql()
_O = "SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 <> 0 THEN o_orderstatus END AS status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ordered, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR) AS price FROM orders"
_REC = """concat('{"id":', id, CASE WHEN status IS NOT NULL THEN concat(',"status":"', status, '"') ELSE '' END, ',"ordered":"', ordered, '","price":"', price, '"}')"""
_R2 = f"{BASE}, {ATTR_ROWS}, kinds AS (SELECT DISTINCT {KEYS}, widget_type FROM details), ar AS (SELECT a.*, k.widget_type FROM attr_rows a JOIN kinds k USING ({KEYS}))"

ORACLE = {
    "a06_canonical_nodes": "SELECT event_id, '' AS path, event_type AS tag, CAST(user_id AS VARCHAR) AS user_name, CAST(NULL AS VARCHAR) AS text FROM events UNION ALL SELECT event_id, '0', 'props', NULL, props FROM events UNION ALL SELECT event_id, '1', 'leaf', NULL, NULL FROM events",
    "a09_drop_blank_rows": "SELECT * FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '  ' WHEN turn % 3 = 0 THEN NULL ELSE role END AS a, CASE WHEN conv_id % 3 = 0 THEN '' ELSE text END AS b FROM conversations) WHERE trim(coalesce(a, '')) <> '' OR trim(coalesce(b, '')) <> ''",
    "a10_unique_headers": "SELECT sheet, pos, CASE WHEN n > 1 THEN concat(f, '_', n) ELSE f END AS name FROM (SELECT *, row_number() OVER (PARTITION BY sheet, f ORDER BY pos) AS n FROM (SELECT concat(conv_id, '-', turn) AS sheet, CAST(pos AS INTEGER) AS pos, coalesce(nullif(CASE WHEN pos % 4 = 3 THEN '' ELSE trim(lower(name)) END, ''), concat('column_', pos + 1)) AS f FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS name, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM conversations)))",
    "a11_align_rows": f"SELECT conv_id, turn, {', '.join(f'w[{k + 1}] AS c{k}' for k in range(6))} FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)",
    "a12_json_records": f"SELECT id, {_REC} AS record FROM ({_O})",
    "a13_jsonl": f"""SELECT concat('{{"sheet":"orders","record":', {_REC}, '}}') AS line FROM ({_O})""",
    "a14_json_safe": _O,
    "a15_written_instances": f"{_S} SELECT widget_type, mapping_id, instance_id, instance_name, count(*) OVER (PARTITION BY widget_type) AS rows, true AS whole FROM rep_widget_inst",
    "a19_resolve_inputs": "SELECT min(page_id) AS pos, path FROM (SELECT page_id, concat(regexp_extract(url, '^https?://([^/]+)/', 1), '/f', page_id % 7, CASE WHEN page_id % 2 = 0 THEN '.JSON' ELSE '.xml' END) AS path FROM pages) WHERE path LIKE '%.JSON' GROUP BY 2",
    "d02d_lookup_port_conditions": f"{_R2}, n AS (SELECT mapping_id, instance_id, widget_id, list_filter(list_transform(string_split(regexp_replace(replace(attr_value, ';', ' AND '), '(?i)\\s+AND\\s+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM ar WHERE attr_name = 'LOOKUP CONDITION' AND attr_value IS NOT NULL), c AS (SELECT mapping_id, instance_id, widget_id, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS condition_order, unnest(parts) AS x FROM n), e AS (SELECT *, regexp_extract(x, '<>|!=|<=|>=|=|<|>') AS o FROM c), lk AS (SELECT DISTINCT mapping_id, instance_id, widget_id FROM ar WHERE widget_type = 11) SELECT lk.mapping_id, lk.instance_id, lk.widget_id, f.field_name, e.condition_order, CASE WHEN o <> '' THEN nullif(trim(regexp_extract(x, '^(.*?)\\s*(<>|!=|<=|>=|=|<|>)', 1)), '') END AS lookup_column, CASE WHEN o <> '' THEN o END AS operator FROM lk JOIN opb_widget_field f ON f.widget_id = lk.widget_id LEFT JOIN e ON e.mapping_id = lk.mapping_id AND e.instance_id = lk.instance_id AND e.o <> '' AND upper(trim(regexp_replace(x, '^.*?(<>|!=|<=|>=|=|<|>)', ''))) = upper(trim(f.field_name))",
    "d03b_lookup_override": f"{_R2} SELECT {KEYS}, string_agg(attr_value, '' ORDER BY line_no, attr_id, attr_value) AS long_text FROM ar WHERE widget_type = 11 AND attr_name = 'LOOKUP SQL OVERRIDE' AND attr_value IS NOT NULL GROUP BY ALL",
    "d05b_qualifier_sql": f"{_R2} SELECT {KEYS}, coalesce(rtrim(string_agg(attr_value, chr(10) ORDER BY line_no, attr_id, attr_value) FILTER (attr_name = 'SQL QUERY')), max(attr_value) FILTER (attr_name IN ('SQL OVERRIDE', 'SQL QUERY OVERRIDE', 'SOURCE FILTER'))) AS sql_query FROM ar WHERE widget_type = 3 AND (attr_name IN ('SQL OVERRIDE', 'SQL QUERY OVERRIDE', 'SOURCE FILTER') OR (attr_name = 'SQL QUERY' AND attr_value IS NOT NULL)) GROUP BY {KEYS}",
    "f03_resolve_definitions": f"{_S}, fo AS (SELECT subject_id, definition, min(type) AS type FROM x_inst GROUP BY 1, 2), lo AS (SELECT mapping_id, definition, max(type) AS type FROM x_inst WHERE type = 'Target Definition' GROUP BY 1, 2), us AS (SELECT DISTINCT subject_id, mapping_id, definition FROM x_inst) SELECT us.mapping_id, us.definition AS name, coalesce(lo.type, fo.type) AS type, CASE WHEN lo.type IS NOT NULL THEN 'mapping' WHEN fo.type IS NOT NULL THEN 'folder' END AS level FROM us LEFT JOIN lo USING (mapping_id, definition) LEFT JOIN fo USING (subject_id, definition)",
    "f44_detail_match": f"{_S}, i AS (SELECT DISTINCT concat('S_', mapping_id) AS session_name, concat('m_', mapping_id) AS mapping_name, definition AS name FROM x_inst), dt AS (SELECT CASE WHEN instance_id % 3 = 0 THEN concat('S_', mapping_id) END AS s, CASE WHEN instance_id % 3 <> 2 THEN concat('m_', mapping_id) END AS m, definition AS n, concat('t', instance_id) AS text FROM x_inst), g1 AS (SELECT s, m, n, string_agg(DISTINCT text, chr(10) ORDER BY text) AS t FROM dt WHERE s IS NOT NULL AND m IS NOT NULL GROUP BY 1, 2, 3), g2 AS (SELECT m, n, string_agg(DISTINCT text, chr(10) ORDER BY text) AS t FROM dt WHERE m IS NOT NULL GROUP BY 1, 2), g3 AS (SELECT n, string_agg(DISTINCT text, chr(10) ORDER BY text) AS t FROM dt GROUP BY 1) SELECT i.session_name, i.mapping_name, i.name, CASE WHEN g1.t IS NOT NULL THEN 1 WHEN g2.t IS NOT NULL THEN 2 WHEN g3.t IS NOT NULL THEN 3 END AS level, coalesce(g1.t, g2.t, g3.t) AS details FROM i LEFT JOIN g1 ON g1.s = i.session_name AND g1.m = i.mapping_name AND g1.n = i.name LEFT JOIN g2 ON g2.m = i.mapping_name AND g2.n = i.name LEFT JOIN g3 ON g3.n = i.name",
    "f45_logic_text": f"{_S}, r AS (SELECT DISTINCT mapping_id, instance, field AS port, trim(expression) AS text FROM x_port WHERE trim(coalesce(expression, '')) <> '' UNION SELECT mapping_id, instance, NULL, trim(value) FROM x_attr WHERE lower(name) LIKE '%condition%'), k AS (SELECT * FROM r QUALIFY (port IS NOT NULL) = (count(port) OVER (PARTITION BY mapping_id, instance) > 0)) SELECT mapping_id, instance, CASE WHEN count(*) = 1 THEN max(text) ELSE string_agg(concat(CASE WHEN port IS NULL THEN '' ELSE port || ': ' END, text), chr(10) ORDER BY concat(CASE WHEN port IS NULL THEN '' ELSE port || ': ' END, text)) END AS logic FROM k GROUP BY 1, 2",
    "f46_resolve_mapping": f"{_S} SELECT s.session_name, s.ord, s.mapping_name, m.mapping_id, CASE WHEN m.mapping_id IS NULL THEN 'missing' ELSE 'found' END AS status FROM x_session s LEFT JOIN rep_all_mappings m ON m.mapping_name = s.mapping_name",
    "f48_ordered_rows": f"{_S} SELECT p.mapping_id, p.instance, p.field, i.ord AS inst_ord, CAST(row_number() OVER (PARTITION BY p.mapping_id ORDER BY i.ord, p.instance, p.field) AS INTEGER) AS place FROM x_port p JOIN x_inst i ON i.mapping_id = p.mapping_id AND i.instance = p.instance",
    "i02_logic_by_hop": f"{_S.replace('WITH ', 'WITH RECURSIVE ', 1)}, q AS ({_LINEAGE['f42_forward_paths']}), h AS (SELECT mapping_id, list_last(string_split(path, ' -> ')) AS target, unnest(string_split(path, ' -> ')) AS node, CAST(generate_subscripts(string_split(path, ' -> '), 1) - 1 AS INTEGER) AS hop FROM q), x AS (SELECT w.mapping_id, concat(w.instance_id, '.', f.field_name) AS node, string_agg(o.expression, chr(10) ORDER BY line_no) AS expression FROM rep_widget_inst w JOIN opb_widget_field f ON f.widget_id = w.widget_id JOIN opb_widget_expr e ON e.widget_id = w.widget_id AND e.output_field_id = f.field_id JOIN opb_expression o ON o.widget_id = e.widget_id AND o.expr_id = e.expr_id GROUP BY 1, 2) SELECT mapping_id, target, hop, string_agg(expression, chr(10) ORDER BY expression) AS logic FROM (SELECT DISTINCT h.mapping_id, h.target, h.hop, x.expression FROM h JOIN x ON x.mapping_id = h.mapping_id AND x.node = h.node) GROUP BY 1, 2, 3",
    "i04_expand_mapplets": f"{_S}, mp AS (SELECT mapping_id, instance, instance_id % 3 AS k FROM x_inst WHERE type = 'Mapplet'), f AS (SELECT concat('F', unnest(range(1, 8))) AS f), e AS (SELECT c.mapping_id, CASE a.k WHEN 0 THEN a.instance || '/NESTED/EXP_A' WHEN 1 THEN a.instance || '/EXP_A' WHEN 2 THEN a.instance || '/EXP_B' ELSE from_inst END AS from_inst, from_field, CASE b.k WHEN 0 THEN b.instance || '/NESTED/EXP_A' WHEN 1 THEN b.instance || '/EXP_A' WHEN 2 THEN b.instance || '/EXP_A' ELSE to_inst END AS to_inst, to_field FROM x_conn c LEFT JOIN mp a ON a.mapping_id = c.mapping_id AND a.instance = c.from_inst LEFT JOIN mp b ON b.mapping_id = c.mapping_id AND b.instance = c.to_inst WHERE (a.k IS NULL OR from_field IN (SELECT f FROM f)) AND (b.k IS NULL OR to_field IN (SELECT f FROM f))) SELECT DISTINCT * FROM (SELECT * FROM e UNION ALL SELECT mapping_id, instance || '/EXP_A', f, instance || '/EXP_B', f FROM mp, f WHERE k = 2)",
    "j05_sequence": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS sequence_no FROM orders",
}
