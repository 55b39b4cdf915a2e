"""Registered queries and their SQL, by name."""

from __future__ import annotations

from folioscope.plans import layout_queries, queries as plain


def queries() -> dict:
    return plain.QUERIES | layout_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return plain.ORACLE | layout_queries.ORACLE
