"""Registered queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from loomtide.plans import archive_queries, scalar_queries, tree_vector_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (scalar_queries, archive_queries, tree_vector_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
