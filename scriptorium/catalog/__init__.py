"""Registered queries over the given tables, and their SQL equivalents."""

from scriptorium.catalog.oracle import oracle_sql
from scriptorium.catalog.queries import queries

__all__ = ["queries", "oracle_sql"]
