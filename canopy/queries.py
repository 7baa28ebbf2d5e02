"""Registry of the queries and their SQL twins."""

from __future__ import annotations

from canopy.plans import classification, features, files, models, quality, relational, spatial, stats, tiles  # noqa: F401
from canopy.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
