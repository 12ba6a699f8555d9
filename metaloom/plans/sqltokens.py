"""Queries of the SQL tokeniser over texts of many shapes. What is to be found in each shape is written by hand."""

from __future__ import annotations

from metaloom.functions import sqltokens as S
from metaloom.sources.fixture import repository, with_sql
from metaloom.sources.store import cut

KEYS = ["instance_id"]


def _lexed(spark, d):
    texts = cut(S.lexed(repository(spark, d)["y_sql"], KEYS, "sql"), "sql")
    return texts, cut(S.tokens(texts, KEYS), "tokens")


def f39(spark, d):
    return S.select_items(*_lexed(spark, d), KEYS)


def g22(spark, d):
    return S.where_clauses(*_lexed(spark, d), KEYS)


def g23(spark, d):
    return S.tables(_lexed(spark, d)[1], KEYS)


def g24(spark, d):
    keys = [*KEYS, "of_block"]
    texts = S.lexed(g22(spark, d).withColumnRenamed("block", "of_block"), keys, "where_text")
    return S.condition_fields(S.tokens(texts, keys), keys).withColumnRenamed("of_block", "block")


QUERIES = {"f39_items_and_aliases": f39, "g22_where_of_blocks": g22, "g23_tables_and_aliases": g23, "g24_condition_fields": g24}

#: By shape: (block, number, item, expression, alias, qualified columns).
_ITEMS = [
    (0, 1, 1, "A.F1", "A.F1", "F1", "A.F1"), (0, 1, 2, "B.F2 AS X", "B.F2", "X", "B.F2"),
    (1, 1, 1, '"Own"."Tab {n}"."Col A" as "Out"', '"Own"."Tab {n}"."Col A"', "Out", '"Own"."Tab {n}"."Col A"'), (1, 1, 2, "NVL(t.b, 'x, y') y", "NVL(t.b, 'x, y')", "y", "t.b"),
    (2, 1, 1, "(SELECT MAX(Z.V) FROM TAB_Z Z WHERE Z.ID = A.ID) MAXV", "(SELECT MAX(Z.V) FROM TAB_Z Z WHERE Z.ID = A.ID)", "MAXV", "Z.V, Z.ID, A.ID"), (2, 1, 2, "A.ID", "A.ID", "ID", "A.ID"), (2, 2, 1, "MAX(Z.V)", "MAX(Z.V)", None, "Z.V"),
    (3, 1, 1, "ID", "ID", "ID", ""), (3, 1, 2, "V", "V", "V", ""), (3, 2, 1, "C.ID", "C.ID", "ID", "C.ID"), (3, 2, 2, "C.V", "C.V", "V", "C.V"),
    (4, 1, 1, "A", "A", "A", ""), (4, 2, 1, "B", "B", "B", ""),
    (5, 1, 1, "A", "A", "A", ""), (5, 1, 2, "D", "D", "D", ""),
    (6, 1, 1, "EXTRACT(DAY FROM D) AS DY", "EXTRACT(DAY FROM D)", "DY", ""), (6, 1, 2, "CASE WHEN A IN (1, 2) THEN 'a,b' ELSE 'c' END K", "CASE WHEN A IN (1, 2) THEN 'a,b' ELSE 'c' END", "K", ""),
    (7, 1, 1, "COUNT(*) CNT", "COUNT(*)", "CNT", ""), (7, 2, 1, "X.A", "X.A", "A", "X.A"),
    (8, 1, 1, "*", "*", None, ""),
    (10, 1, 1, "a.b.c.D", "a.b.c.D", "D", "a.b.c.D"), (10, 1, 2, "E + 1", "E + 1", None, ""),
    (11, 1, 1, "'it''s' AS Q", "'it''s'", "Q", ""), (11, 1, 2, '"x""y"', '"x""y"', 'x"y', ""),
]
_WHERE = [
    (0, 1, "A.F1 > 10"), (1, 1, "t.b <> ')' and t.c in (1, 2)"), (2, 2, "Z.ID = A.ID"), (3, 1, "V > 0"), (4, 1, "A = 1"), (4, 2, "B = 2"), (5, 1, "D = '--no'"), (7, 1, "S.A > 5"), (7, 2, "X.A IS NOT NULL"), (10, 1, "D = F.E(+) AND N = 1.5"), (11, 1, "Q LIKE '%WHERE%'"),
]
_TABLES = [
    (0, 1, "TAB_{n}", "A"), (0, 2, "TAB_B", "B"), (1, 1, "Tab {n}", "t"), (2, 1, "TAB_Z", "Z"), (2, 2, "TAB_{n}", "A"), (3, 1, "TAB_{n}", None), (3, 2, "Tab Two", "T"), (4, 1, "TAB_{n}", None), (4, 2, "OTHER", None), (5, 1, "TAB_{n}", None), (6, 1, "TAB_{n}", None), (7, 1, "TAB_{n}", "X"), (10, 1, "TAB_{n}", None), (11, 1, "TAB_{n}", None),
]
_FIELDS = [(0, 1, 1, "F1"), (1, 1, 1, "b"), (1, 1, 2, "c"), (2, 2, 1, "ID"), (3, 1, 1, "V"), (4, 1, 1, "A"), (4, 2, 1, "B"), (5, 1, 1, "D"), (7, 1, 1, "A"), (7, 2, 1, "A"), (10, 1, 1, "D"), (10, 1, 2, "E"), (10, 1, 3, "N"), (11, 1, 1, "Q")]


def _literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _by_hand(rows: list[tuple], names: str) -> str:
    """The rows of each text's shape, with the text's own number put in."""
    columns = names.split(", ")
    shown = [f"CAST(h.{c} AS BIGINT) AS {c}" if isinstance(rows[0][i + 1], int) else f"replace(h.{c}, '{{n}}', CAST(instance_id % 50 AS VARCHAR)) AS {c}" for i, c in enumerate(columns)]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"{with_sql()}, h AS (SELECT * FROM (VALUES {values}) AS v(shape, {names})) SELECT instance_id, {', '.join(shown)} FROM y_sql JOIN h ON h.shape = y_sql.shape"


ORACLE = {
    "f39_items_and_aliases": _by_hand(_ITEMS, "block, item_no, item, expression, alias, columns"),
    "g22_where_of_blocks": _by_hand(_WHERE, "block, where_text"),
    "g23_tables_and_aliases": _by_hand(_TABLES, "n, table_name, alias"),
    "g24_condition_fields": _by_hand(_FIELDS, "block, n, field"),
}
