"""Every telemetry query by name, with the SQL that expresses the same rows."""

from __future__ import annotations

from wayfold.plans import fleet_queries, ingest_queries, lifecycle_queries, mapping_queries, route_queries, selection_queries, trip_queries

MODULES = (trip_queries, ingest_queries, mapping_queries, fleet_queries, route_queries, selection_queries, lifecycle_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
