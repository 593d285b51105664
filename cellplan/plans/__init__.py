"""Registered queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations


def _modules():
    from . import cohort_queries, measure_queries, raster_queries, seed_queries

    return [raster_queries, measure_queries, cohort_queries, seed_queries]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _modules() for name, sql in m.ORACLE_SQL.items()}
