"""Names of the reference-derived queries and their DuckDB oracles."""

from __future__ import annotations

from parchment.plans import commands, documents, lookups, mapping, more, packages, relations, scalars, streams, structure  # noqa: F401  they register themselves
from parchment.plans.catalog import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
