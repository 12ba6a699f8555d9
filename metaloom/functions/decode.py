"""Decodes of repository codes, as SQL expressions over a column. The code tables are fixed values."""

from __future__ import annotations

YES = ("1", "YES", "Y", "TRUE", "CHECKED")
NO = ("0", "NO", "N", "FALSE", "UNCHECKED")
TRACING = {"1": "Terse", "2": "Normal", "3": "Verbose Initialization", "4": "Verbose Data"}
JOIN_TYPES = {"0": "Normal Join", "1": "Master Outer Join", "2": "Detail Outer Join", "3": "Full Outer Join"}
NULL_ORDERS = {"0": "Null Is Lowest Value", "1": "Null Is Highest Value"}
SCOPES = {"0": "All Input", "1": "Transaction", "2": "Row"}
DATATYPES = {-5: "string", -4: "text", -3: "binary", -2: "varbinary", -1: "long varbinary", 0: "unknown", 1: "small integer", 2: "integer", 3: "decimal", 4: "real", 5: "double", 6: "date/time", 7: "date/time", 8: "date/time", 9: "date/time", 10: "string", 11: "string", 12: "string", 13: "binary", 14: "bigint", 15: "double", 16: "decimal", 17: "boolean"}
#: Bits of the port type.
PORT_BITS = {"i": 1, "o": 2, "l": 4, "r": 8, "v": 32}


def _case(of: str, pairs: dict[str, str], other: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {other} END"


def _both(pairs: dict[str, str]) -> dict[str, str]:
    """Codes, and the names in upper case."""
    return pairs | {v.upper(): v for v in pairs.values()}


def tracing(x: str, variant: str = "generic") -> str:
    """Tracing level: 'expression' has no default, 'joiner' passes unknown text, 'lookup' too, 'generic' marks it."""
    unknown = f"concat('Unknown (', coalesce({x}, ''), ')')"
    if variant == "expression":
        return _case(f"trim({x})", TRACING, unknown)
    if variant == "joiner":
        return _case(f"trim({x})", _both(TRACING), f"coalesce({x}, 'Normal')")
    other = x if variant == "lookup" else unknown
    return f"CASE WHEN {x} IS NULL THEN 'Normal' ELSE {_case(f'upper(trim({x}))', _both(TRACING), other)} END"


def yes_no(x: str, variant: str = "generic") -> str:
    """Flag: generic gives NO for null and keeps unknown text; 'lookup' keeps null, else NO; 'joiner' keeps null and unknown text."""
    if variant == "lookup":
        return f"CASE WHEN upper({x}) IN ('1', 'YES', 'TRUE', 'Y') THEN 'YES' WHEN {x} IS NULL THEN NULL ELSE 'NO' END"
    if variant == "joiner":
        return _case(f"upper(trim({x}))", {"1": "YES", "0": "NO", "YES": "YES", "NO": "NO", "TRUE": "YES", "FALSE": "NO"}, x)
    return f"CASE WHEN {x} IS NULL THEN 'NO' WHEN upper(trim({x})) IN {YES} THEN 'YES' WHEN upper(trim({x})) IN {NO} THEN 'NO' ELSE {x} END"


def join_type(x: str) -> str:
    names = _both(JOIN_TYPES) | {"FULL OUTER": "Full Outer Join", "MASTER OUTER": "Master Outer Join", "DETAIL OUTER": "Detail Outer Join"}
    return _case(f"upper(trim({x}))", names, x)


def null_order(x: str) -> str:
    return _case(f"upper(trim({x}))", _both(NULL_ORDERS), x)


def scope(x: str) -> str:
    return _case(f"upper(trim({x}))", _both(SCOPES), x)


def datatype(x: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in DATATYPES.items())
    return f"CASE {x} {cases} ELSE concat('Unknown (', CAST({x} AS VARCHAR(20)), ')') END"


def extension_type(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 1 THEN 'String' WHEN {x} = 2 THEN 'Number' WHEN {x} = 3 THEN 'Boolean' ELSE concat('Other (', CAST({x} AS VARCHAR(20)), ')') END"


def port_flag(x: str, bit: str) -> str:
    return f"CASE WHEN ({x} & {PORT_BITS[bit]}) <> 0 THEN 'YES' ELSE 'NO' END"


def port_flag_equal(x: str, bit: str) -> str:
    """The Expression variant: equality instead of bits."""
    test = {"i": f"{x} IN (1, 3)", "o": f"{x} IN (2, 3)", "v": f"{x} = 32"}[bit]
    return f"CASE WHEN {test} THEN 'YES' ELSE 'NO' END"


def present(x: str) -> str:
    """Blank text is null, as in the repository's database."""
    return f"nullif(trim({x}), '')"


OPERATORS = "<>|!=|<=|>=|=|<|>"
