"""All queries of the evaluation operators by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import documents, pages, scored, tables, texts

_ALL = {**texts.Q, **tables.Q, **pages.Q, **scored.Q, **documents.Q}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
