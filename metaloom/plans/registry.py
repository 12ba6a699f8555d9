"""All registered queries of the metadata engine and their oracle SQL."""

from . import chain_order, chains, extras, lineage, metadata, more, orders, records, reports, special, sqltokens, typed, workflow

_MODULES = (metadata, lineage, more, reports, typed, workflow, chains, extras, orders, chain_order, records, sqltokens, special)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
