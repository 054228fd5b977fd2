"""All queries over the generic tables."""

from __future__ import annotations

from . import events, reports, run_views, tables, texts, upkeep_views, views  # noqa: F401  importing a module registers its queries
from .catalogue import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
