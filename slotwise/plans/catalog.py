"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from slotwise.plans import documents, exports, intervals, layout, outcomes, relational, scalars

MODULES = (intervals, relational, scalars, layout, documents, exports, outcomes)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
