"""Registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from filelens.plans import catalog_queries, change_queries, check_queries, ingest_queries, more_queries

_MODULES = (catalog_queries, ingest_queries, more_queries, change_queries, check_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
