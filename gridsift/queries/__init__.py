"""Queries over the driver's tables: one for each operator, with DuckDB SQL for the same rows."""

from __future__ import annotations

from . import edit_queries, file_queries, search_queries, sql_queries

MODULES = (search_queries, sql_queries, edit_queries, file_queries)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
