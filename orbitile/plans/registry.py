"""All queries of the engine's own operators, and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("select_queries", "pixel_queries", "work_queries", "flow_queries", "more_queries")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f"orbitile.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
