"""Columns that read SQL fragments and transformation expressions; all built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that an expression or a condition calls and never reads as fields (fixed values of the ETL expression language and of SQL).
FUNCTIONS = [
    "IIF", "ISNULL", "ISNUMBER", "ISDATE", "ISSPACESONLY", "NVL", "NVL2", "NULLIF", "COALESCE", "LTRIM", "RTRIM", "TRIM", "UPPER", "LOWER", "SUBSTR", "INSTR", "LENGTH", "LPAD", "RPAD", "CONCAT", "REPLACE", "REVERSE", "CHR", "ASCII", "SOUNDEX",
    "REG_EXTRACT", "REG_MATCH", "REG_REPLACE", "ABS", "ROUND", "TRUNC", "FLOOR", "CEIL", "MOD", "POWER", "SQRT", "EXP", "LOG", "SIN", "COS", "TAN", "TO_INTEGER", "TO_DECIMAL", "TO_CHAR", "TO_DATE", "TO_BIGINT", "TO_FLOAT", "CAST", "CONVERT",
    "DATE_DIFF", "ADD_TO_DATE", "GET_DATE_PART", "MAKE_DATE", "SET_DATE_PART", "LAST_DAY", "NEXT_DAY", "SYSTIMESTAMP", "SYSDATE", "CURRENT_DATE", "CURRENT_TIMESTAMP", "SUM", "AVG", "COUNT", "MIN", "MAX", "FIRST", "LAST", "MEDIAN", "PERCENTILE", "STDDEV", "VARIANCE",
    "SEQGEN", "NEXTVAL", "CURRVAL", "ERROR", "ABORT", "AND", "OR", "NOT", "TRUE", "FALSE", "NULL", "DECODE", "ROW_NUMBER", "RANK", "DENSE_RANK", "OVER", "PARTITION", "BY", "ORDER", "ASC", "DESC", "SELECT", "FROM", "WHERE", "JOIN", "INNER", "OUTER", "LEFT", "RIGHT", "FULL",
    "CROSS", "ON", "GROUP", "HAVING", "UNION", "INTERSECT", "MINUS", "DISTINCT", "AS", "IN", "LIKE", "BETWEEN", "EXISTS", "CASE", "WHEN", "THEN", "ELSE", "END", "IS", "INTO", "SET", "DUAL", "CONNECT", "START", "WITH", "PRIOR", "LEVEL", "ROWNUM", "ROWID",
    "METAPHONE", "METACODE", "SNOWID",
]
_KEYWORDS = ["SELECT", "WHERE", "ON", "LATERAL", "DUAL"]


def compact(text: Column) -> Column:
    """White space runs to one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")


def where_clause(sql: Column) -> Column:
    """The text after WHERE up to GROUP, ORDER or HAVING; null where there is none."""
    got = F.regexp_extract(compact(without_comments(sql)), r"(?i)\bWHERE\b\s+(.*?)(?=\s+(?:GROUP\s+BY|ORDER\s+BY|HAVING)\b|\s*;?\s*$)", 1)
    return F.nullif(F.trim(got), F.lit(""))


def sql_tables(sql: Column) -> Column:
    """Table names after FROM and JOIN in order, owner and link removed, each once."""
    found = F.regexp_extract_all(without_comments(sql), F.lit(r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z0-9_.$#@]+)"), 1)
    bare = F.transform(found, lambda x: F.upper(F.element_at(F.split(F.split(x, "@")[0], r"\."), -1)))
    return F.array_distinct(F.filter(bare, lambda x: ~x.isin(_KEYWORDS) & (x != "")))


def table_aliases(sql: Column) -> Column:
    """I12: 'table alias' for each table of FROM and JOIN that has an alias."""
    pairs = F.regexp_extract_all(without_comments(sql), F.lit(r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z0-9_.$#@]+\s+(?!ON\b|WHERE\b|JOIN\b)[A-Za-z0-9_]+)"), 1)
    return F.array_distinct(F.transform(pairs, lambda x: F.upper(F.regexp_replace(x, r"\s+", " "))))


def field_tokens(text: Column) -> Column:
    """Identifiers of an expression, without comments, literals and function names, each once."""
    bare = F.regexp_replace(without_comments(text), "'[^']*'", " ")
    found = F.regexp_extract_all(bare, F.lit(r"([A-Za-z_][A-Za-z0-9_$#]*)"), 1)
    return F.array_distinct(F.filter(F.transform(found, F.upper), lambda x: ~x.isin(FUNCTIONS)))


def field_refs(expression: Column) -> Column:
    """Names of an expression as they are written, without line comments, literals and function names, each once."""
    bare = F.regexp_replace(F.regexp_replace(expression, r"--[^\n]*", " "), "'[^']*'", " ")
    found = F.regexp_extract_all(bare, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\b"), 1)
    return F.array_distinct(F.filter(found, lambda x: ~F.upper(x).isin(FUNCTIONS)))


def is_pass_through(expression: Column, field: Column) -> Column:
    """no expression, a single identifier, or the field itself."""
    text = F.trim(F.coalesce(expression, F.lit("")))
    return (text == "") | text.rlike(r"^[A-Za-z_][A-Za-z0-9_$#]*$") | (F.upper(text) == F.upper(field))


def select_items(sql: Column) -> Column:
    """the items of the first SELECT list, cut at commas outside parentheses and quotes."""
    listed = F.regexp_extract(compact(without_comments(sql)), r"(?i)^\s*SELECT\s+(?:DISTINCT\s+)?(.*?)\s+FROM\b", 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(s, c):
        quoted = F.when(c == "'", ~s["quoted"]).otherwise(s["quoted"])
        depth = s["depth"] + F.when(~quoted & (c == "("), 1).when(~quoted & (c == ")"), -1).otherwise(0)
        cut = ~quoted & (depth == 0) & (c == ",")
        return F.struct(
            depth.alias("depth"), quoted.alias("quoted"), F.when(cut, "").otherwise(F.concat(s["now"], c)).alias("now"),
            F.when(cut, F.concat(s["out"], F.array(F.trim(s["now"])))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(F.split(listed, ""), start, step, lambda s: F.filter(F.concat(s["out"], F.array(F.trim(s["now"]))), lambda x: x != ""))


def alias_of(item: Column) -> Column:
    """a select item's alias: after AS, else the last name after a blank, else the name after the dot, else itself."""
    names = [r"(?i)\bAS\s+([A-Za-z_][A-Za-z0-9_$#]*)\s*$", r"[\w)']\s+([A-Za-z_][A-Za-z0-9_$#]*)\s*$", r"^[A-Za-z_][\w$#]*\.([A-Za-z_][\w$#]*)$"]
    return F.coalesce(*[F.nullif(F.regexp_extract(item, p, 1), F.lit("")) for p in names], item)


def condition_rows(condition: Column) -> Column:
    """A lookup condition's parts: semicolons count as AND."""
    whole = F.regexp_replace(F.replace(condition, F.lit(";"), F.lit(" AND ")), r"(?i)\s+AND\s+", "\u0001")
    return F.filter(F.transform(F.split(whole, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def condition_parts(part: Column) -> tuple[Column, Column, Column]:
    """Left side, first operator, right side; nulls where there is no operator."""
    pattern = r"^(.*?)\s*(<>|!=|<=|>=|=|<|>)\s*(.*)$"
    has = part.rlike("<>|!=|<=|>=|=|<|>")
    return tuple(F.when(has, F.nullif(F.trim(F.regexp_extract(part, pattern, i)), F.lit(""))) for i in (1, 2, 3))


#: Patterns in order with the words for what the first that is found says; \1 and on are its groups (fixed values).
PLAIN_RULES = [
    (r"^\s*(\w+)\s*$", r"Pass through \1 without change"),
    (r"(?i)IIF\s*\(\s*(.+?)\s*,\s*(.+?)\s*,\s*(.+?)\s*\)\s*$", r"If \1 then \2, otherwise \3"),
    (r"(?i)DECODE\s*\(", "Map value using DECODE logic"),
    (r"(?i)NVL2?\s*\(", "Replace NULL values using NVL logic"),
    (r"(?i)(L?R?TRIM)\s*\(\s*(\w+)\s*\)\s*$", r"Trim whitespace from \2"),
    (r"(?i)(UPPER|LOWER)\s*\(\s*(\w+)\s*\)\s*$", r"Convert \2 to \1 case"),
    (r"(?i)SUBSTR(?:ING)?\s*\(\s*(\w+)\s*,\s*(\d+)\s*(?:,\s*(\d+))?\s*\)", r"Extract part of \1 starting at position \2"),
    (r"(?i)TO_DATE\s*\(\s*(\w+)\s*,\s*'(.+?)'\s*\)", r"Parse \1 as date using format '\2'"),
    (r"(?i)TO_CHAR\s*\(\s*(\w+)", r"Convert \1 to text"),
    (r"\|\|", "Concatenate values"),
    (r"[\+\-\*/]", "Apply arithmetic calculation"),
    (r"(?i)\bLKP\.", "Perform a lookup"),
    (r"(?i)\bSEQGEN\b|\bNEXTVAL\b", "Generate next sequence value"),
    (r"(?i)\bSYSDATE\b|\bSYSTIMESTAMP\b", "Use current system date/time"),
]
#: Most characters of an expression that no pattern knows.
SHORT = 140


def plain_rule(expression: Column) -> Column:
    """an expression in plain words, by the first pattern that is found in it."""
    text = F.trim(F.coalesce(expression, F.lit("")))
    out = F.when(text == "", "No transformation logic provided")
    for pattern, words in PLAIN_RULES:
        parts = [F.regexp_extract(text, pattern, int(p)) if k % 2 else F.lit(p) for k, p in enumerate(re.split(r"\\(\d)", words))]
        out = out.when(text.rlike(pattern), F.concat(*parts))
    whole = compact(text)
    cut = F.concat(F.rtrim(F.regexp_extract(whole, rf"^(.{{0,{SHORT - 4}}})(?=\s)", 1)), F.lit(" ..."))
    return out.otherwise(F.concat(F.lit("Apply expression: "), F.when(F.length(whole) <= SHORT, whole).otherwise(F.ltrim(cut))))


def clean_text(text: Column) -> Column:
    """Line ends made equal, lines trimmed, blank lines dropped."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")
