"""All registered queries."""

from __future__ import annotations


def _catalogs():
    from airlake.catalog import forecasts, modelling, pipelines, rows, summaries

    return [rows.catalog, summaries.catalog, forecasts.catalog, pipelines.catalog, modelling.catalog]


def all_queries():
    return {name: q for c in _catalogs() for name, q in c.queries.items()}


def all_sql():
    return {name: q for c in _catalogs() for name, q in c.sql.items()}
