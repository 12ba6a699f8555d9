"""Queries of chains across sessions, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import chains as C
from metaloom.operators import lineage
from metaloom.sources.fixture import repository, with_sql
from metaloom.sources.store import cut


def _edges(spark, d):
    repo = repository(spark, d)
    return repo, C.normalised_edges(repo["x_conn"], repo["x_inst"])


def _feeds(spark, d):
    repo, edges = _edges(spark, d)
    return repo, C.upstream(repo["x_port"], edges)


def _tables(repo):
    known = repo["x_inst"].where("type in ('Source Definition', 'Target Definition')").select("subject_id", F.col("definition").alias("table_name"))
    return C.physical_tables(repo["x_inst"].select("mapping_id", "subject_id", "instance", "definition"), known)


def _chain(spark, d):
    repo, feeds = _feeds(spark, d)
    feeds = cut(feeds, "feeds")
    crossings = C.crossing_edges(repo["x_inst"], lineage.upstream_mapping(repo["inst_table"]), _tables(repo))
    edges = cut(C.chain_edges(repo["x_port"], feeds, crossings), "chain-edges")
    starts = _starts(repo)
    return repo, edges, starts, C.chain(starts, edges)


def _starts(repo):
    """Fields of all targets."""
    return repo["x_port"].where("type = 'Target Definition'").select(C.node("mapping_id", "instance", "field").alias("start")).distinct()


def g01(spark, d):
    return _edges(spark, d)[1]


def g02(spark, d):
    repo, edges = _edges(spark, d)
    return C.union_bridge(repo["x_port"], edges)


def g03(spark, d):
    inst = repository(spark, d)["x_inst"]
    given = inst.selectExpr("mapping_id", "instance", "definition", "CASE WHEN instance_id % 4 = 0 THEN '' ELSE type END AS trans_type", "CASE WHEN instance_id % 3 = 0 THEN 'TRANSFORMATION' END AS raw_type")
    return C.resolved_types(given, inst.groupBy("mapping_id", F.col("definition").alias("name")).agg(F.min("type").alias("type")))


def g04(spark, d):
    return _tables(repository(spark, d))


def g05(spark, d):
    repo = repository(spark, d)
    return _tables(repo).join(repo["x_inst"].where("type = 'Target Definition'").select("mapping_id", "instance"), ["mapping_id", "instance"], "left_semi")


def g08(spark, d):
    repo = repository(spark, d)
    return C.mappings_for_targets(repo["x_inst"], _tables(repo))


def g09(spark, d):
    return _chain(spark, d)[3].select("start", "node")


def g09_edges(spark, d):
    return _chain(spark, d)[1]


def g10(spark, d):
    return C.branch_markers(_feeds(spark, d)[1])


def g11(spark, d):
    return C.expression_annotation(repository(spark, d)["x_port"])


def g13(spark, d):
    """Also with names for types, half of them unknown."""
    rows = repository(spark, d)["x_inst"].selectExpr("concat(CASE instance_id % 5 WHEN 0 THEN 'sq_' WHEN 1 THEN 'EXP' WHEN 2 THEN 'CUST-' ELSE '' END, instance) AS instance", "CASE WHEN instance_id % 2 = 0 THEN type END AS type", "instance_id % 7 = 0 AS is_source_table")
    return rows.select("instance", C.is_intermediate().alias("is_intermediate"))


def g14(spark, d):
    repo, edges, _, steps = _chain(spark, d)
    return C.primary_sources(steps, edges, C.step_facts(repo["x_port"]))


def g15(spark, d):
    return g14(spark, d).where("by_sequence").select("start", "primary_sources")


def g16(spark, d):
    repo, _, _, steps = _chain(spark, d)
    return C.intermediates(steps, C.step_facts(repo["x_port"]))


def g17(spark, d):
    repo, _, _, steps = _chain(spark, d)
    return C.chain_mappings(steps, C.step_facts(repo["x_port"]))


def g19(spark, d):
    repo = repository(spark, d)
    return C.port_conditions(repo["x_port"], repo["x_attr"])


def g20(spark, d):
    return C.attribute_conditions(repository(spark, d)["x_attr"])


def g21(spark, d):
    """The attributes of a few repository types, read as those of connector types."""
    attr = repository(spark, d)["x_attr"].selectExpr("mapping_id", "instance", "CASE type WHEN 'Filter' THEN 'Salesforce Source Qualifier' WHEN 'Source Qualifier' THEN 'SAP ERP Source Qualifier' WHEN 'Lookup Procedure' THEN 'Salesforce Lookup' WHEN 'Joiner' THEN 'MQSeries Consumer' END AS type", "CASE WHEN name = 'Cache Directory' THEN 'Queue Name' WHEN name = 'Lookup Condition' THEN 'Lookup condition' ELSE name END AS name", "value").where("type is not null")
    return C.attribute_conditions(attr)


def g27(spark, d):
    repo, edges, starts, steps = _chain(spark, d)
    facts = C.step_facts(repo["x_port"])
    conditions = C.port_conditions(repo["x_port"], repo["x_attr"]).select("mapping_id").unionAll(C.attribute_conditions(repo["x_attr"]).select("mapping_id"))
    return C.field_specs(starts, C.primary_sources(steps, edges, facts), C.chain_mappings(steps, facts), conditions)


def g28(spark, d):
    return _starts(repository(spark, d))


def g30(spark, d):
    rows = repository(spark, d)["x_inst"].selectExpr("concat(CASE instance_id % 6 WHEN 0 THEN 'sq_' WHEN 1 THEN 'JNR' WHEN 2 THEN 'MQC_' WHEN 3 THEN 'RANK' ELSE '' END, instance) AS instance")
    return rows.select("instance", C.step_role().alias("role"))


QUERIES = {
    "g01_normalised_edges": g01, "g02_union_bridge": g02, "g03_resolved_types": g03, "g04_physical_tables": g04, "g05_target_definitions": g05, "g08_mappings_for_targets": g08, "g09_chain": g09, "g09_chain_edges": g09_edges, "g10_branch_markers": g10, "g11_expression_annotation": g11, "g13_is_intermediate": g13,
    "g14_primary_sources": g14, "g15_sequence_sources": g15, "g16_intermediates": g16, "g17_chain_mappings": g17, "g19_port_conditions": g19, "g20_attribute_conditions": g20, "g21_connector_conditions": g21, "g27_field_specs": g27, "g28_target_field_list": g28, "g30_step_role": g30,
}

_S = with_sql()
_BARE = "regexp_replace({x}, '[.:].*$', '')"
_TYPES = "types AS (SELECT DISTINCT mapping_id, split_part(instance, '.', 1) AS i, type FROM x_inst)"
_E = f"""{_TYPES}, ne AS MATERIALIZED (SELECT DISTINCT c.mapping_id, split_part(from_inst, '.', 1) AS from_inst, CASE WHEN f.type = 'Router' AND from_field LIKE '%_.%' THEN regexp_replace(from_field, '^[^.]+\\.', '') ELSE from_field END AS from_field, split_part(to_inst, '.', 1) AS to_inst, CASE WHEN t.type = 'Normalizer' AND to_field LIKE '%_.%' THEN regexp_replace(to_field, '^[^.]+\\.', '') ELSE to_field END AS to_field FROM x_conn c LEFT JOIN types f ON f.mapping_id = c.mapping_id AND f.i = split_part(from_inst, '.', 1) LEFT JOIN types t ON t.mapping_id = c.mapping_id AND t.i = split_part(to_inst, '.', 1)),
un AS (SELECT * FROM x_port WHERE type = 'Custom Transformation' AND template = 'Union Transformation'),
ou AS (SELECT mapping_id, instance, field, row_number() OVER (PARTITION BY mapping_id, instance ORDER BY ord) AS place FROM un WHERE porttype = 'OUTPUT' OR (grp = '' AND porttype <> 'INPUT')),
inn AS (SELECT mapping_id, instance, field, row_number() OVER (PARTITION BY mapping_id, instance, grp ORDER BY ord) AS place FROM un WHERE porttype = 'INPUT' AND grp <> ''),
bridge AS MATERIALIZED (SELECT DISTINCT o.mapping_id, o.instance, o.field, e.from_inst, e.from_field FROM ou o JOIN inn i ON i.mapping_id = o.mapping_id AND i.instance = o.instance AND i.place = o.place JOIN ne e ON e.mapping_id = o.mapping_id AND e.to_inst = o.instance AND e.to_field = i.field),
feed AS MATERIALIZED (SELECT mapping_id, to_inst AS instance, to_field AS field, from_inst, from_field FROM ne WHERE NOT EXISTS (SELECT 1 FROM bridge b WHERE b.mapping_id = ne.mapping_id AND b.instance = ne.to_inst AND b.field = ne.to_field) UNION ALL SELECT * FROM bridge),
kn AS (SELECT DISTINCT subject_id, definition FROM x_inst WHERE type IN ('Source Definition', 'Target Definition')),
pt AS MATERIALIZED (SELECT i.mapping_id, i.instance, CASE WHEN (i.subject_id, i.definition) IN (SELECT subject_id, definition FROM kn) THEN i.definition WHEN (i.subject_id, i.instance) IN (SELECT subject_id, definition FROM kn) THEN i.instance ELSE i.definition END AS table_name FROM x_inst i)"""
_UPS = "wr AS (SELECT DISTINCT table_name, mapping_id AS writer FROM inst_table WHERE widget_type = 2), rd AS (SELECT DISTINCT table_name, mapping_id AS reader FROM inst_table WHERE widget_type = 1), ups AS (SELECT reader, table_name, coalesce(max(CASE WHEN writer < reader THEN writer END), max(writer)) AS upstream FROM rd JOIN wr USING (table_name) WHERE writer <> reader GROUP BY 1, 2)"
_N = "CAST({m} AS VARCHAR) || '|' || {i} || '.' || {f}"


def _n(m: str, i: str, f: str) -> str:
    return _N.format(m=m, i=i, f=f)


def _chain_sql() -> str:
    from .lineage import _TOKENS

    return f"""{_S.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_E}, {_UPS},
cross_to AS (SELECT s.mapping_id, s.instance, u.upstream, min(t.instance) AS target FROM x_inst s JOIN pt a ON a.mapping_id = s.mapping_id AND a.instance = s.instance JOIN ups u ON u.reader = s.mapping_id AND u.table_name = a.table_name JOIN x_inst t ON t.mapping_id = u.upstream AND t.type = 'Target Definition' JOIN pt b ON b.mapping_id = t.mapping_id AND b.instance = t.instance AND b.table_name = a.table_name WHERE s.type = 'Source Definition' GROUP BY 1, 2, 3),
own AS MATERIALIZED (SELECT mapping_id, split_part(instance, '.', 1) AS instance, field, type, expression FROM x_port),
idle AS MATERIALIZED (SELECT * FROM own WHERE NOT EXISTS (SELECT 1 FROM feed f WHERE f.mapping_id = own.mapping_id AND f.instance = own.instance AND f.field = own.field)),
oth AS (SELECT instance, field, min(mapping_id) AS other FROM feed GROUP BY 1, 2),
rest AS (SELECT * FROM idle WHERE NOT EXISTS (SELECT 1 FROM oth o WHERE o.instance = idle.instance AND o.field = idle.field)),
ce AS MATERIALIZED (SELECT DISTINCT {_n('mapping_id', 'instance', 'field')} AS node, {_n('mapping_id', 'from_inst', 'from_field')} AS parent, 'connector' AS kind FROM feed
UNION SELECT {_n('i.mapping_id', 'i.instance', 'i.field')}, {_n('f.mapping_id', 'f.from_inst', 'f.from_field')}, 'other_mapping' FROM idle i JOIN oth o ON o.instance = i.instance AND o.field = i.field JOIN feed f ON f.mapping_id = o.other AND f.instance = i.instance AND f.field = i.field
UNION SELECT {_n('r.mapping_id', 'r.instance', 'r.field')}, {_n('c.upstream', 'c.target', 'r.field')}, 'session' FROM rest r JOIN cross_to c ON c.mapping_id = r.mapping_id AND c.instance = r.instance
UNION SELECT {_n('r.mapping_id', 'r.instance', 'r.field')}, {_n('o.mapping_id', 'o.instance', 'o.field')}, 'expression' FROM (SELECT *, unnest({_TOKENS.format(x='expression')}) AS token FROM rest WHERE expression IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cross_to c WHERE c.mapping_id = rest.mapping_id AND c.instance = rest.instance)) r JOIN own o ON o.mapping_id = r.mapping_id AND o.instance = r.instance AND upper(o.field) = r.token AND o.field <> r.field),
st AS (SELECT DISTINCT {_n('mapping_id', 'instance', 'field')} AS start FROM x_port WHERE type = 'Target Definition'),
hop AS MATERIALIZED (SELECT DISTINCT node, parent FROM ce),
ch AS (SELECT start, start AS node FROM st UNION SELECT ch.start, hop.parent FROM ch JOIN hop ON hop.node = ch.node),
fa AS (SELECT {_n('mapping_id', "split_part(instance, '.', 1)", 'field')} AS node, mapping_id, instance, field, type FROM x_port),
src AS (SELECT start, count(CASE WHEN type = 'Sequence' THEN 1 END) > 0 AS by_sequence, CASE WHEN count(CASE WHEN type = 'Sequence' THEN 1 END) > 0 THEN string_agg(DISTINCT CASE WHEN type = 'Sequence' THEN instance || '.' || field END, ', ' ORDER BY CASE WHEN type = 'Sequence' THEN instance || '.' || field END) ELSE coalesce(string_agg(DISTINCT CASE WHEN leaf AND type NOT IN ({_INTER}) THEN instance || '.' || field END, ', ' ORDER BY CASE WHEN leaf AND type NOT IN ({_INTER}) THEN instance || '.' || field END), '') END AS primary_sources FROM (SELECT ch.start, fa.*, NOT EXISTS (SELECT 1 FROM hop h WHERE h.node = ch.node) AS leaf FROM ch JOIN fa ON fa.node = ch.node) GROUP BY 1)"""


#: The fixture's types that are on the way.
_INTER = "'Source Qualifier', 'Expression', 'Filter', 'Lookup Procedure', 'Joiner', 'Aggregator', 'Sorter', 'Router', 'Normalizer', 'Rank', 'Update Strategy', 'Sequence', 'Stored Procedure', 'Custom Transformation', 'Mapplet', 'Transaction Control', 'Target Definition'"
_PRE = "'^(SQ|EXP|EXPTRANS|FILTRANS|FIL|NRM|NORM|SEQ|RTR|ROUTER|JNR|JOINER|AGG|SRT|SORTER|RANK|LKP|LOOKUP|UPD|UPDATE|JAVA|UNION|XML|SP|SPROC|PROC|EXTPROC|MPT|MAPLET|TRANS|CUSTOM|CUST|SQL|TXN|TC|MASK|DM|HP|HIER|CDC|WS|WSC|WSP|MQ|MQC|MQP|SAP|BAPI|IDOC|SFDC|SF|PWX)[A-Z0-9_]*$'"
_CH = _chain_sql()
_PC = """pc AS (SELECT mapping_id, instance, '[Aggregator GROUP BY] ' || string_agg(field, ', ' ORDER BY ord) AS text FROM x_port WHERE type = 'Aggregator' AND porttype LIKE '%GROUP%' GROUP BY 1, 2
UNION ALL SELECT mapping_id, instance, '[Sorter] Sort by: ' || string_agg(field || ' ' || coalesce(sort_order, 'ASC'), ', ' ORDER BY ord) FROM x_port WHERE type = 'Sorter' AND porttype LIKE '%KEY%' GROUP BY 1, 2
UNION ALL SELECT mapping_id, instance, '[Rank] Rank by: ' || string_agg(field, ', ' ORDER BY ord) FROM x_port WHERE type = 'Rank' AND porttype LIKE '%KEY%' GROUP BY 1, 2
UNION ALL SELECT mapping_id, instance, '[Sequence] ' || string_agg(name || '=' || value, ', ' ORDER BY list_position(['Start Value', 'Increment By', 'End Value', 'Cycle'], name)) FROM x_attr WHERE type = 'Sequence' AND name IN ('Start Value', 'Increment By', 'End Value', 'Cycle') GROUP BY 1, 2),
ac AS (SELECT mapping_id, instance, 'additional' AS bucket, '[StoredProc] ' || trim(regexp_replace(value, '\\s+', ' ', 'g')) AS text FROM x_attr WHERE type = 'Stored Procedure' AND name = 'Stored Procedure Name' UNION ALL SELECT mapping_id, instance, 'additional', '[SQLTrans] ' || trim(regexp_replace(value, '\\s+', ' ', 'g')) FROM x_attr WHERE type = 'SQL' AND name = 'Sql Query' UNION ALL SELECT mapping_id, instance, 'filter', '[TransactionControl] ' || trim(regexp_replace(value, '\\s+', ' ', 'g')) FROM x_attr WHERE type = 'Transaction Control' AND name = 'Transaction Control Condition')"""

ORACLE = {
    "g01_normalised_edges": f"{_S}, {_E} SELECT * FROM ne",
    "g02_union_bridge": f"{_S}, {_E} SELECT * FROM bridge",
    "g03_resolved_types": f"{_S}, df AS (SELECT mapping_id, definition AS name, min(type) AS type FROM x_inst GROUP BY 1, 2) SELECT i.mapping_id, i.instance, coalesce(a.type, CASE WHEN instance_id % 4 <> 0 THEN i.type END, CASE WHEN instance_id % 3 = 0 THEN 'TRANSFORMATION' END, b.type) AS type FROM x_inst i LEFT JOIN df a ON a.mapping_id = i.mapping_id AND a.name = i.instance LEFT JOIN df b ON b.mapping_id = i.mapping_id AND b.name = i.definition",
    "g04_physical_tables": f"{_S}, {_E} SELECT * FROM pt",
    "g05_target_definitions": f"{_S}, {_E} SELECT pt.* FROM pt JOIN x_inst i ON i.mapping_id = pt.mapping_id AND i.instance = pt.instance WHERE i.type = 'Target Definition'",
    "g08_mappings_for_targets": f"{_S}, {_E} SELECT pt.table_name, pt.mapping_id, pt.instance FROM pt JOIN x_inst i ON i.mapping_id = pt.mapping_id AND i.instance = pt.instance WHERE i.type = 'Target Definition' UNION SELECT instance, mapping_id, instance FROM x_inst WHERE type = 'Target Definition'",
    "g09_chain": f"{_CH} SELECT * FROM ch",
    "g09_chain_edges": f"{_CH} SELECT * FROM ce",
    "g10_branch_markers": f"{_S}, {_E}, f AS (SELECT DISTINCT * FROM feed) SELECT mapping_id, instance, field, from_inst, from_field, CAST(row_number() OVER (PARTITION BY mapping_id, instance, field ORDER BY from_inst, from_field) AS INTEGER) AS branch FROM f QUALIFY count(*) OVER (PARTITION BY mapping_id, instance, field) > 1",
    "g11_expression_annotation": f"{_S} SELECT mapping_id, instance, field, concat('EXPR:', instance, '.', field, ' = ', trim(expression)) AS annotation FROM x_port WHERE type IN ('Expression', 'Aggregator', 'Filter', 'Router', 'Rank', 'Normalizer', 'Update Strategy', 'Custom Transformation', 'Transaction Control') AND trim(expression) NOT IN ('', field)",
    "g13_is_intermediate": f"{_S}, n AS (SELECT concat(CASE instance_id % 5 WHEN 0 THEN 'sq_' WHEN 1 THEN 'EXP' WHEN 2 THEN 'CUST-' ELSE '' END, instance) AS instance, CASE WHEN instance_id % 2 = 0 THEN type END AS type, instance_id % 7 = 0 AS s FROM x_inst) SELECT instance, CASE WHEN s THEN false WHEN type IS NOT NULL THEN type IN ({_INTER}) ELSE regexp_matches(upper(instance), {_PRE}) END AS is_intermediate FROM n",
    "g14_primary_sources": f"{_CH} SELECT * FROM src",
    "g15_sequence_sources": f"{_CH} SELECT start, primary_sources FROM src WHERE by_sequence",
    "g16_intermediates": f"{_CH} SELECT DISTINCT ch.start, fa.mapping_id, fa.instance FROM ch JOIN fa ON fa.node = ch.node WHERE type IN ({_INTER}) AND type <> 'Target Definition'",
    "g17_chain_mappings": f"{_CH} SELECT ch.start, fa.mapping_id, count(*) AS n_steps FROM ch JOIN fa ON fa.node = ch.node GROUP BY 1, 2",
    "g19_port_conditions": f"{_S}, {_PC} SELECT * FROM pc",
    "g20_attribute_conditions": f"{_S}, {_PC} SELECT * FROM ac",
    "g21_connector_conditions": f"{_S} SELECT mapping_id, instance, 'filter' AS bucket, '[SalesforceSourceQual] ' || trim(regexp_replace(value, '\\s+', ' ', 'g')) AS text FROM x_attr WHERE type = 'Filter' AND name = 'Filter Condition' UNION ALL SELECT mapping_id, instance, 'filter', '[SAPERPSourceQual WHERE] ' || regexp_extract(value, 'WHERE (.*) ORDER BY', 1) FROM x_attr WHERE type = 'Source Qualifier' AND name = 'Sql Query' UNION ALL SELECT mapping_id, instance, 'additional', '[SalesforceLookup] ' || trim(regexp_replace(value, '\\s+', ' ', 'g')) FROM x_attr WHERE type = 'Lookup Procedure' AND lower(name) = 'lookup condition' UNION ALL SELECT mapping_id, instance, 'additional', '[MQConsumer] queue: ' || trim(regexp_replace(value, '\\s+', ' ', 'g')) FROM x_attr WHERE type = 'Joiner' AND name = 'Cache Directory'",
    "g27_field_specs": f"{_CH}, {_PC}, cm AS (SELECT ch.start, fa.mapping_id FROM ch JOIN fa ON fa.node = ch.node GROUP BY 1, 2), nc AS (SELECT mapping_id, count(*) AS n FROM (SELECT mapping_id FROM pc UNION ALL SELECT mapping_id FROM ac) GROUP BY 1), m AS (SELECT start, count(*) AS n_mappings, coalesce(sum(n), 0) AS n_conditions FROM cm LEFT JOIN nc USING (mapping_id) GROUP BY 1) SELECT st.start, coalesce(primary_sources, '') AS primary_sources, coalesce(by_sequence, false) AS by_sequence, CAST(coalesce(n_mappings, 0) AS BIGINT) AS n_mappings, CAST(coalesce(n_conditions, 0) AS BIGINT) AS n_conditions, CASE WHEN coalesce(primary_sources, '') = '' THEN 'error: no source' ELSE 'ok' END AS status FROM st LEFT JOIN src USING (start) LEFT JOIN m USING (start)",
    "g28_target_field_list": f"{_CH} SELECT * FROM st",
    "g30_step_role": f"{_S}, n AS (SELECT concat(CASE instance_id % 6 WHEN 0 THEN 'sq_' WHEN 1 THEN 'JNR' WHEN 2 THEN 'MQC_' WHEN 3 THEN 'RANK' ELSE '' END, instance) AS instance FROM x_inst) SELECT instance, CASE WHEN instance LIKE 'sq\\_%' ESCAPE '\\' THEN 'Source Qualifier' WHEN starts_with(instance, 'JNR') THEN 'Joiner' WHEN starts_with(instance, 'MQC_') THEN 'MQSeries' WHEN regexp_matches(upper(instance), {_PRE}) THEN 'Intermediate' ELSE 'Intermediate Table' END AS role FROM n",
}
