"""All registered queries and oracles, collected from the query modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("measurement_queries", "table_queries", "place_queries", "series_queries", "study_queries", "map_queries", "model_queries")


def _modules():
    return [import_module(f"wayloom.plans.{name}") for name in MODULES]


def queries() -> dict:
    return {key: fn for module in _modules() for key, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for module in _modules() for key, sql in module.ORACLE.items()}
