"""Every query of the core by name, and its SQL."""

from __future__ import annotations

from . import documents, knowledge, quantities, retrieval, service

FLAGSHIP = "p3_found"
MODULES = (quantities, documents, retrieval, knowledge, service)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
