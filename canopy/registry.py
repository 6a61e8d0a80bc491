"""Named queries of the library and their SQL; see each operator's module for the semantics."""

from __future__ import annotations

import importlib

#: Modules whose ``QUERIES`` map a name to (query, SQL or None).
MODULES = ["hierarchy_queries", "search_queries", "validation_queries", "entity_queries", "record_queries", "link_queries", "catalogue_queries", "version_queries", "bundle_queries"]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

for _module in MODULES:
    for _name, (_query, _sql) in importlib.import_module(f"canopy.plans.{_module}").QUERIES.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLE_SQL[_name] = _sql
