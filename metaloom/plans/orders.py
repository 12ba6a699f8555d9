"""Queries of exact run orders, with DuckDB SQL that plays the queues node by node."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloom.operators import overview, run_order
from metaloom.sources.fixture import repository, with_sql


def _flow(spark, d):
    repo = repository(spark, d)
    return repo["y_link"], repo["x_task"], repo["x_session"]


def _named(df):
    return df.withColumn("mapping_name", F.concat(F.lit("m_"), F.col("mapping_id").cast("string")))


def e03_queue(spark, d):
    repo = repository(spark, d)
    return run_order.transformation_queue(repo["x_inst"], repo["y_definition"], repo["y_conn"])


def e07_walk(spark, d):
    return run_order.walked_links(*_flow(spark, d))


def e08_queue(spark, d):
    return run_order.session_queue(*_flow(spark, d))


def e11(spark, d):
    links, tasks, _ = _flow(spark, d)
    return run_order.session_order(links, tasks)


def e12_ranks(spark, d):
    return run_order.session_ranks(*_flow(spark, d))


def e21_tables(spark, d):
    repo = repository(spark, d)
    return run_order.session_tables(e07_walk(spark, d), _named(repo["x_inst"]), _named(repo["x_load_order"]))


def e22_flow(spark, d):
    return run_order.table_flow(e21_tables(spark, d))


def f47_ranked(spark, d):
    repo = repository(spark, d)
    order = e11(spark, d).join(overview.session_lookup(repo["x_session"]), "session_name")
    side = F.when(F.col("type") == "Source Definition", "source").when(F.col("type") == "Target Definition", "target")
    fields = repo["x_port"].select("mapping_id", "instance", "field").join(repo["x_inst"].select("mapping_id", "instance", "definition", side.alias("side")), ["mapping_id", "instance"]).where("side is not null")
    return run_order.ranked_links(order, _named(fields).select("mapping_name", "side", F.col("definition").alias("table_name"), "field").distinct())


def e13_order(spark, d):
    return run_order.session_transformations(*_flow(spark, d), _named(e03_queue(spark, d)).select("mapping_name", "transformation", "place"))


QUERIES = {"e13_transformations_in_order": e13_order, "e03_queue_order": e03_queue, "e07_walk_order": e07_walk, "e08_queue_order": e08_queue, "e11_session_order": e11, "e12_session_ranks": e12_ranks, "e21_session_tables_in_order": e21_tables, "e22_table_flow": e22_flow, "f47_ranked_links": f47_ranked}

_W = with_sql().replace("WITH ", "WITH RECURSIVE ", 1)


def _queue(nodes: str, edges: str, least: bool = False) -> str:
    """CTEs up to kahn(k, node, pos), one node out in each step; nodes (k, node, ord), edges (k, src, dst, ord)."""
    served = "CASE WHEN len(p.srcs) = 0 THEN p.ord ELSE list_max(list_transform(p.preds, lambda x: CAST(list_position(q.done, x.src) AS BIGINT) * 1000000000 + x.ord)) END"
    return f"""kn AS (SELECT k, node, row_number() OVER (PARTITION BY k ORDER BY min(ord)) AS ord FROM ({nodes}) WHERE node <> '' GROUP BY k, node),
ke AS (SELECT e.k, e.src, e.dst, min(e.ord) AS ord FROM ({edges}) e JOIN kn a ON a.k = e.k AND a.node = e.src JOIN kn b ON b.k = e.k AND b.node = e.dst GROUP BY 1, 2, 3),
kp AS (SELECT n.k, n.node, n.ord, coalesce(list(e.src) FILTER (e.src IS NOT NULL), []) AS srcs, list({{'src': e.src, 'ord': e.ord}}) FILTER (e.src IS NOT NULL) AS preds FROM kn n LEFT JOIN ke e ON e.k = n.k AND e.dst = n.node GROUP BY 1, 2, 3),
kq AS (SELECT DISTINCT k, 0 AS n, CAST([] AS VARCHAR[]) AS done FROM kn UNION ALL SELECT q.k, q.n + 1, list_append(any_value(q.done), arg_min(p.node, {'p.ord' if least else served})) FROM kq q JOIN kp p ON p.k = q.k WHERE NOT list_contains(q.done, p.node) AND list_has_all(q.done, p.srcs) GROUP BY q.k, q.n),
kf AS (SELECT k, arg_max(done, n) AS done FROM kq GROUP BY k),
kahn AS (SELECT n.k, n.node, CASE WHEN list_contains(done, node) THEN list_position(done, node) ELSE len(done) + row_number() OVER (PARTITION BY n.k, list_contains(done, node) ORDER BY n.ord) END AS pos, NOT list_contains(done, node) AS looped FROM kn n JOIN kf ON kf.k = n.k)"""


_LIVE = "live AS (SELECT * FROM y_link WHERE from_task <> '' AND to_task <> ''), begun AS (SELECT DISTINCT workflow_id FROM live WHERE from_task = 'Start')"
_SESS = "sess AS (SELECT session_name, max_by(mapping_name, ord) AS mapping_name FROM x_session WHERE session_name <> '' GROUP BY 1)"
_TASKS = "ts AS (SELECT workflow_id, task, max_by(session_name, (ord, session_name)) AS session_name FROM (SELECT workflow_id, name AS task, coalesce(nullif(task_name, ''), name) AS session_name, ord FROM x_task WHERE task_type = 'Session' UNION ALL SELECT workflow_id, task_name, coalesce(nullif(task_name, ''), name), ord FROM x_task WHERE task_type = 'Session') WHERE task <> '' GROUP BY 1, 2)"
_NAMED = "SELECT l.workflow_id, pos, coalesce(f.session_name, l.from_task) AS from_session, t.session_name AS to_session, coalesce(nullif(condition, ''), '[condition: none defined]') AS condition, coalesce(s.mapping_name, '') AS mapping_name FROM {} l JOIN ts t ON t.workflow_id = l.workflow_id AND t.task = l.to_task LEFT JOIN ts f ON f.workflow_id = l.workflow_id AND f.task = l.from_task LEFT JOIN sess s ON s.session_name = t.session_name"

#: The walk as a stack machine: each step follows the first untaken link of the task on top, or goes back.
_WALK = f"""{_LIVE}, {_SESS}, {_TASKS},
once AS (SELECT workflow_id, from_task, to_task, coalesce(condition, '') AS condition, min(ord) AS ord FROM live WHERE workflow_id IN (SELECT workflow_id FROM begun) GROUP BY ALL),
outs AS (SELECT workflow_id, from_task, list({{'ord': ord, 'dst': to_task}} ORDER BY ord) AS steps FROM once GROUP BY 1, 2),
st AS (SELECT workflow_id, 0 AS n, ['Start'] AS stack, CAST([] AS BIGINT[]) AS taken FROM begun UNION ALL
SELECT workflow_id, n + 1, CASE WHEN step IS NULL THEN stack[:-2] ELSE list_append(stack, step.dst) END, CASE WHEN step IS NULL THEN taken ELSE list_append(taken, step.ord) END FROM (
  SELECT st.workflow_id, n, stack, taken, list_filter(o.steps, lambda x: NOT list_contains(st.taken, x.ord))[1] AS step FROM st LEFT JOIN outs o ON o.workflow_id = st.workflow_id AND o.from_task = stack[-1] WHERE len(stack) > 0)),
fin AS (SELECT workflow_id, arg_max(taken, n) AS taken FROM st GROUP BY 1),
wk AS (SELECT o.workflow_id, from_task, to_task, condition, CAST(list_position(taken, o.ord) AS BIGINT) AS pos FROM once o JOIN fin ON fin.workflow_id = o.workflow_id WHERE list_contains(taken, o.ord) UNION ALL
SELECT workflow_id, from_task, to_task, coalesce(condition, ''), row_number() OVER (PARTITION BY workflow_id ORDER BY ord) FROM live WHERE workflow_id NOT IN (SELECT workflow_id FROM begun)),
walk AS ({_NAMED.format('wk')})"""
_TAB = """src AS (SELECT mapping_id, string_agg(definition, ', ' ORDER BY ord, definition) AS sources FROM x_inst WHERE type = 'Source Definition' AND definition <> '' GROUP BY 1),
giv AS (SELECT mapping_id, target_instance, max(try_cast(ord AS INTEGER)) AS given FROM x_load_order WHERE target_instance <> '' AND ord <> '' GROUP BY 1, 2),
tgt AS (SELECT i.mapping_id, string_agg(definition, ', ' ORDER BY given NULLS FIRST, i.ord) AS targets FROM x_inst i LEFT JOIN giv g ON g.mapping_id = i.mapping_id AND g.target_instance = i.instance WHERE type = 'Target Definition' AND (given IS NOT NULL OR i.mapping_id NOT IN (SELECT mapping_id FROM giv)) GROUP BY 1),
tabs AS (SELECT workflow_id, CAST(row_number() OVER (PARTITION BY workflow_id ORDER BY pos) AS INTEGER) AS place, to_session AS session_name, mapping_name FROM walk),
st2 AS (SELECT workflow_id, place, session_name, t.mapping_name, coalesce(sources, '') AS sources, coalesce(targets, '') AS targets FROM tabs t JOIN (SELECT DISTINCT mapping_id FROM x_inst) i ON t.mapping_name = concat('m_', i.mapping_id) LEFT JOIN src ON src.mapping_id = i.mapping_id LEFT JOIN tgt ON tgt.mapping_id = i.mapping_id)"""
_E03 = _queue(
    "SELECT i.mapping_id AS k, instance AS node, ord FROM x_inst i SEMI JOIN y_conn c ON c.mapping_id = i.mapping_id UNION ALL SELECT d.mapping_id, transformation, 1000000 + ord FROM y_definition d SEMI JOIN y_conn c ON c.mapping_id = d.mapping_id UNION ALL SELECT mapping_id, from_inst, 2000000 + 2 * ord FROM y_conn UNION ALL SELECT mapping_id, to_inst, 2000001 + 2 * ord FROM y_conn",
    "SELECT mapping_id AS k, from_inst AS src, to_inst AS dst, ord FROM y_conn",
)
_NODES = "SELECT workflow_id AS k, 'Start' AS node, 0 AS ord FROM x_task UNION ALL SELECT workflow_id, name, 1000000 + ord FROM x_task UNION ALL SELECT workflow_id, from_task, 3000000 + 2 * ord FROM y_link UNION ALL SELECT workflow_id, to_task, 3000001 + 2 * ord FROM y_link"
_E08 = f"""{_LIVE}, {_SESS}, {_TASKS}, nd AS (SELECT k, node, min(ord) AS ord FROM ({_NODES}) WHERE node <> '' GROUP BY 1, 2),
rch AS (SELECT workflow_id, 'Start' AS task FROM begun UNION SELECT r.workflow_id, l.to_task FROM rch r JOIN live l ON l.workflow_id = r.workflow_id AND l.from_task = r.task),
{_queue("SELECT nd.* FROM nd WHERE k NOT IN (SELECT workflow_id FROM begun) UNION ALL SELECT nd.* FROM nd JOIN rch ON rch.workflow_id = nd.k AND rch.task = nd.node", "SELECT l.workflow_id AS k, from_task AS src, to_task AS dst, nd.ord FROM live l JOIN nd ON nd.k = l.workflow_id AND nd.node = l.to_task")},
so AS (SELECT k AS workflow_id, t.session_name AS to_session, min(pos) AS pos FROM kahn JOIN ts t ON t.workflow_id = k AND t.task = node GROUP BY 1, 2),
li AS (SELECT workflow_id, from_task, to_task, condition, ord AS pos FROM live), fd AS ({_NAMED.format('li')}),
fr AS (SELECT workflow_id, to_session, string_agg(from_session, ', ' ORDER BY pos) AS from_session FROM (SELECT workflow_id, to_session, from_session, min(pos) AS pos FROM fd GROUP BY 1, 2, 3) GROUP BY 1, 2),
co AS (SELECT workflow_id, to_session, string_agg(condition, ' | ' ORDER BY pos, condition) AS condition FROM (SELECT workflow_id, to_session, condition, min(pos) AS pos FROM fd GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT so.workflow_id, CAST(row_number() OVER (PARTITION BY so.workflow_id ORDER BY so.pos) AS INTEGER) AS place, so.to_session, coalesce(from_session, '') AS from_session, coalesce(condition, '[condition: none defined]') AS condition, coalesce(mapping_name, '') AS mapping_name FROM so LEFT JOIN fr USING (workflow_id, to_session) LEFT JOIN co USING (workflow_id, to_session) LEFT JOIN sess ON sess.session_name = so.to_session"""
_E11 = f"""own AS (SELECT workflow_id, name, max(ord) AS ord, max_by(coalesce(nullif(task_name, ''), name), ord) AS session_name FROM x_task WHERE lower(task_type) = 'session' AND name <> '' GROUP BY 1, 2),
{_queue("SELECT workflow_id AS k, name AS node, ord FROM own", "SELECT workflow_id AS k, from_task AS src, to_task AS dst, ord FROM y_link", least=True)},
so11 AS (SELECT k AS workflow_id, CAST(pos AS BIGINT) AS place, node AS task, session_name, looped FROM kahn JOIN own ON own.workflow_id = k AND own.name = node)"""
_E12 = f"""{_LIVE}, {_queue("SELECT workflow_id AS k, from_task AS node, ord FROM live UNION ALL SELECT workflow_id, to_task, 1000000 + ord FROM live", "SELECT workflow_id AS k, from_task AS src, to_task AS dst, ord FROM live")},
lk AS (SELECT session_name, max_by(mapping_name, ord) AS mapping_name FROM x_session WHERE session_name <> '' AND mapping_name <> '' GROUP BY 1),
ne AS (SELECT name, max_by(mapping_name, ord) AS mapping_name FROM x_task JOIN lk ON lk.session_name = coalesce(nullif(task_name, ''), name) WHERE name <> '' GROUP BY 1),
al AS (SELECT k AS workflow_id, node, pos FROM kahn UNION ALL SELECT workflow_id, name, min(ord) FROM x_task WHERE name <> '' AND workflow_id NOT IN (SELECT workflow_id FROM live) GROUP BY 1, 2),
mm AS (SELECT workflow_id, pos, node, coalesce(ne.mapping_name, lk.mapping_name) AS mapping_name FROM al LEFT JOIN ne ON ne.name = node LEFT JOIN lk ON lk.session_name = node),
f1 AS (SELECT mapping_name, min({{'w': workflow_id, 'p': pos, 'n': node}}) AS fst FROM mm WHERE mapping_name IS NOT NULL GROUP BY 1)
SELECT mapping_name, row_number() OVER (ORDER BY fst) - 1 AS rank, fst.n AS task FROM f1"""
_F47 = f"""{_E11}, {_SESS}, od AS (SELECT workflow_id, place, task, mapping_name FROM so11 JOIN sess USING (session_name)),
fl AS (SELECT DISTINCT concat('m_', i.mapping_id) AS mapping_name, i.type, definition AS table_name, field FROM x_port p JOIN x_inst i ON i.mapping_id = p.mapping_id AND i.instance = p.instance WHERE i.type IN ('Source Definition', 'Target Definition')),
af AS (SELECT * FROM od JOIN fl USING (mapping_name)),
pr AS (SELECT DISTINCT r.workflow_id, r.task AS session, r.table_name, r.field, w.place, concat_ws('.', w.task, w.table_name, w.field) || '->' || concat_ws('.', r.task, r.table_name, r.field) AS link FROM af r JOIN af w ON w.workflow_id = r.workflow_id AND lower(w.table_name) = lower(r.table_name) AND lower(w.field) = lower(r.field) AND w.place < r.place WHERE r.type = 'Source Definition' AND w.type = 'Target Definition')
SELECT workflow_id, session, table_name, field, count(*) AS n_links, string_agg(link, chr(10) ORDER BY place, link) AS links FROM pr GROUP BY ALL"""

_ORDERED = "sv AS (SELECT k, coalesce(nullif(definition, ''), node) AS transformation, min(pos) AS pos FROM kahn LEFT JOIN x_inst i ON i.mapping_id = k AND i.instance = node GROUP BY 1, 2), ow AS (SELECT mapping_id, transformation, min(ord) AS ord FROM y_definition WHERE transformation <> '' GROUP BY 1, 2), tq AS (SELECT ow.mapping_id, ow.transformation, CAST(row_number() OVER (PARTITION BY ow.mapping_id ORDER BY sv.pos NULLS LAST, ow.ord) AS INTEGER) AS place FROM ow LEFT JOIN sv ON sv.k = ow.mapping_id AND sv.transformation = ow.transformation)"

ORACLE = {
    "e13_transformations_in_order": f"{_W}, {_WALK}, {_E03}, {_ORDERED} SELECT workflow_id, walk.pos, to_session AS session_name, mapping_name, place, coalesce(transformation, '') AS transformation FROM walk LEFT JOIN tq ON mapping_name = concat('m_', tq.mapping_id)",
    "e03_queue_order": f"{_W}, {_E03}, sv AS (SELECT k, coalesce(nullif(definition, ''), node) AS transformation, min(pos) AS pos FROM kahn LEFT JOIN x_inst i ON i.mapping_id = k AND i.instance = node GROUP BY 1, 2), ow AS (SELECT mapping_id, transformation, min(ord) AS ord FROM y_definition WHERE transformation <> '' GROUP BY 1, 2) SELECT ow.mapping_id, ow.transformation, CAST(row_number() OVER (PARTITION BY ow.mapping_id ORDER BY pos NULLS LAST, ow.ord) AS INTEGER) AS place FROM ow LEFT JOIN sv ON sv.k = ow.mapping_id AND sv.transformation = ow.transformation",
    "e07_walk_order": f"{_W}, {_WALK} SELECT workflow_id, pos, from_session, to_session, condition, mapping_name FROM walk",
    "e08_queue_order": f"{_W}, {_E08}",
    "e11_session_order": f"{_W}, {_E11} SELECT * FROM so11",
    "e12_session_ranks": f"{_W}, {_E12}",
    "e21_session_tables_in_order": f"{_W}, {_WALK}, {_TAB} SELECT * FROM st2",
    "e22_table_flow": f"{_W}, {_WALK}, {_TAB} SELECT workflow_id, coalesce(string_agg(nullif(replace(concat_ws(' -> ', nullif(sources, ''), nullif(targets, '')), ', ', ' -> '), ''), ' -> ' ORDER BY place), '') AS flow FROM st2 GROUP BY 1",
    "f47_ranked_links": f"{_W}, {_F47}",
}
