"""SQL texts as tables of tokens: levels of brackets, query blocks, clauses; and what is read off them.

A text is cut by one pattern into tokens, blanks and comments among them, so that the tokens joined are the text. Levels, blocks and clauses are running sums and last values
over a text's tokens; pieces of text are slices of its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sqltext import FUNCTIONS

_PART = r'(?:"(?:[^"]|"")*"|\[[^\]]*\]|`[^`]*`|[A-Za-z_$][\w$#]*)'
#: Comments, blanks, literals, numbers, names with their dots and links, operators, anything else.
LEX = rf"(?s)(/\*.*?\*/|--[^\n]*|\s+|'(?:[^']|'')*'|\d+(?:\.\d+)?|{_PART}(?:\s*\.\s*(?:{_PART}|\*))*(?:@[\w$#.]+)?|<>|!=|<=|>=|\|\||.)"
CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "CONNECT", "START", "WITH")
SETS = ("UNION", "INTERSECT", "MINUS", "EXCEPT")
#: What may follow a table and is no alias of it.
_AFTER_TABLE = ("ON", "WHERE", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "USING", "GROUP", "ORDER", "HAVING", "SET", *SETS)
#: Words after FROM or JOIN that are no tables (fixed values).
_NO_TABLE = ("SELECT", "WHERE", "ON", "GROUP", "ORDER", "HAVING", "UNION", "DUAL")


def last_part(name: Column) -> Column:
    """The last part of a dotted name, without quotes and link; its case is kept."""
    plain = F.regexp_replace(name, r"@[\w$#.]+$", "")
    part = F.regexp_extract(plain, rf"({_PART}|\*)$", 1)
    return F.when(part.startswith('"'), F.replace(F.regexp_replace(part, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(F.regexp_replace(part, r"^[\[`]|[\]`]$", ""))


def lexed(rows: DataFrame, keys: list[str], sql: str) -> DataFrame:
    """(keys, tokens). Null or blank texts: left out."""
    return rows.where(F.trim(F.col(sql)) != "").select(*keys, F.regexp_extract_all(sql, F.lit(LEX), 1).alias("tokens"))


def tokens(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, token, kind, word, level, grp, query, branch, clause, block, before, after): each token that is neither blank nor comment.

    kind: literal, number, name, symbol. level: brackets around it; a bracket itself is outside. grp: the place of the bracket around it, 0 without. query: whether this group is a query. branch: set operations before it in its
    group. clause: the last clause word of its branch. block: the number of its SELECT in the text. before, after: neighbours in its group, as words.
    """
    rows = texts.select(*keys, F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos") + 1).where(~F.col("token").rlike(r"^(\s|--|/\*)"))
    kind = F.when(F.col("token").startswith("'"), "literal").when(F.col("token").rlike(r"^\d"), "number").when(F.col("token").rlike(rf"^{_PART}"), "name").otherwise("symbol")
    rows = rows.select("*", kind.alias("kind"), F.upper("token").alias("word"))
    text = Window.partitionBy(*keys).orderBy("pos")
    step = F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)
    rows = rows.withColumn("level", F.sum(step).over(text) - F.when(F.col("token") == "(", 1).otherwise(0))
    opened = rows.where("token = '('").select(*keys, "pos", (F.col("level") + 1).alias("level"), F.col("pos").alias("open"))
    rows = rows.withColumn("open", F.lit(None).cast("int")).unionByName(opened, allowMissingColumns=True)
    at_level = Window.partitionBy(*keys, "level").orderBy("pos", F.col("open").isNotNull().desc())
    rows = rows.withColumn("grp", F.coalesce(F.last("open", ignorenulls=True).over(at_level), F.lit(0))).where("token is not null").drop("open")

    group = Window.partitionBy(*keys, "grp").orderBy("pos")
    first = F.first("word").over(group)
    rows = rows.withColumn("query", first.isin("SELECT", "WITH"))
    rows = rows.withColumn("branch", F.count(F.when(F.col("word").isin(*SETS), 1)).over(group))
    branch = Window.partitionBy(*keys, "grp", "branch").orderBy("pos")
    rows = rows.withColumn("clause", F.last(F.when(F.col("word").isin(*CLAUSES) & (F.col("kind") == "name"), F.col("word")), ignorenulls=True).over(branch))
    selects = F.count(F.when(F.col("query") & (F.col("word") == "SELECT"), 1)).over(text)
    rows = rows.withColumn("__n", F.when(F.col("query") & (F.col("word") == "SELECT"), selects))
    rows = rows.withColumn("block", F.last("__n", ignorenulls=True).over(branch)).drop("__n")
    return rows.withColumns({"before": F.lag("word").over(group), "after": F.lead("word").over(group)})


def _sliced(texts: DataFrame, spans: DataFrame, keys: list[str], name: str) -> DataFrame:
    """spans (keys, lo, hi) with the text from token lo to token hi, comments left out and blanks made one."""
    words = F.filter(F.slice("tokens", F.col("lo"), F.col("hi") - F.col("lo") + 1), lambda t: ~t.rlike(r"^(--|/\*)"))
    return spans.join(texts, keys).withColumn(name, F.trim(F.regexp_replace(F.array_join(words, ""), r"\s+", " "))).drop("tokens", "lo", "hi")


def select_items(texts: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, item_no, item, expression, alias, columns): items of every SELECT list, of subqueries and branches too.

    alias: the name after AS, or a name that follows an expression, or the last part of a name that stands alone; null for others. expression: the item without such an alias. columns: qualified names in it, each once.
    """
    own = found.where("query and clause = 'SELECT' and word not in ('SELECT', ';') and not (before = 'SELECT' and word in ('DISTINCT', 'ALL', 'UNIQUE'))")
    block = Window.partitionBy(*keys, "block").orderBy("pos")
    own = own.withColumn("item_no", 1 + F.count(F.when(F.col("token") == ",", 1)).over(block)).where("token <> ','")
    items = own.groupBy(*keys, "block", "item_no").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.array_sort(F.collect_list(F.struct("pos", "token", "kind", "word"))).alias("t"))
    last, second = F.element_at("t", -1), F.try_element_at("t", F.lit(-2))
    is_name = (last["kind"] == "name") & ~last["word"].isin("END", "NULL") & ~last["token"].contains(".") & ~last["word"].isin(*FUNCTIONS)
    with_as = is_name & (second["word"] == "AS")
    ends = (second["kind"] != "symbol") | (second["token"] == ")")
    follows = is_name & (F.size("t") > 1) & ends & (~second["word"].isin(*FUNCTIONS) | (second["word"] == "END"))
    alone = (F.size("t") == 1) & (last["kind"] == "name")
    alias = F.when(with_as | follows, last_part(last["token"])).when(alone, F.nullif(last_part(last["token"]), F.lit("*")))
    named = F.when(with_as, F.element_at("t", -3)["pos"]).when(follows, second["pos"]).otherwise(last["pos"])
    items = items.select(*keys, "block", "item_no", alias.alias("alias"), "lo", "hi", named.alias("end"))
    out = _sliced(texts, items, keys, "item")
    out = _sliced(texts, items.select(*keys, "block", "item_no", "lo", F.col("end").alias("hi")), keys, "expression").join(out.drop("end"), [*keys, "block", "item_no"])
    bare = F.regexp_replace("expression", "'(?:[^']|'')*'", " ")
    columns = F.regexp_extract_all(bare, F.lit(rf"({_PART}(?:\.{_PART})+)"), 1)
    kept = F.filter(columns, lambda c, i: F.array_position(F.transform(columns, F.upper), F.upper(c)) == i + 1)
    return out.select(*keys, F.col("block").cast("long").alias("block"), F.col("item_no").cast("long").alias("item_no"), "item", "expression", "alias", F.array_join(kept, ", ").alias("columns"))


def where_clauses(texts: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, where_text): the WHERE clause of every query block."""
    own = found.where("clause = 'WHERE' and block is not null and word not in ('WHERE', ';') and not (kind = 'name' and word in ('UNION', 'INTERSECT', 'MINUS', 'EXCEPT'))")
    spans = own.groupBy(*keys, F.col("block").cast("long").alias("block")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return _sliced(texts, spans, keys, "where_text").select(*keys, "block", "where_text")


def tables(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, table_name, alias): tables after FROM and JOIN of queries and of the statement itself, in order, without owner, link and quotes; no names of common table expressions, no DUAL; each (table, alias) once."""
    live = found.where("query or grp = 0")
    ctes = live.where("kind = 'name' and after = 'AS' and clause = 'WITH' and before in ('WITH', ',')").select(*keys, F.upper(last_part(F.col("token"))).alias("cte")).distinct()
    group = Window.partitionBy(*keys, "grp").orderBy("pos")
    over = F.when(F.col("after") == "AS", F.lead("token", 2).over(group)).otherwise(F.lead("token", 1).over(group))
    named = over.rlike(rf"^{_PART}$") & ~F.upper(over).isin(*_AFTER_TABLE)
    rows = live.withColumn("alias", F.when(named, last_part(over))).where((F.col("kind") == "name") & F.col("before").isin("FROM", "JOIN") & ~F.col("word").isin(*_NO_TABLE))
    rows = rows.withColumn("table_name", last_part(F.col("token")))
    rows = rows.join(ctes, [*(rows[k].eqNullSafe(ctes[k]) for k in keys), F.upper("table_name") == ctes["cte"]], "left_anti")
    rows = rows.groupBy(*keys, "table_name", "alias").agg(F.min("pos").alias("pos"))
    return rows.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("pos")).cast("long").alias("n"), "table_name", "alias")


def condition_fields(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, field): names in a condition, the last part of dotted ones, as they are written, without functions, key words, numbers and literals, each once."""
    rows = found.where("kind = 'name'").select(*keys, "pos", last_part(F.col("token")).alias("field")).where(~F.upper("field").isin(*FUNCTIONS) & (F.col("field") != "*") & (F.col("field") != ""))
    rows = rows.groupBy(*keys, "field").agg(F.min("pos").alias("pos"))
    return rows.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("pos")).cast("long").alias("n"), "field")
