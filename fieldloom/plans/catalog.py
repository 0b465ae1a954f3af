"""Registry of runnable queries and their DuckDB oracles."""

from __future__ import annotations

from fieldloom.plans import discoveries, geo, rasters, registers, tables, timeline, verdicts, zone

FLAGSHIP = "zone_crops_summary"
PARTS = (geo, zone, timeline, verdicts, rasters, registers, discoveries, tables)


def queries() -> dict:
    """Every query of the parcel engine by name."""
    return {name: q for part in PARTS for name, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql is not None}
