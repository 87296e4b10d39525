"""All registered queries."""

from __future__ import annotations

from pollspark.plans import (  # noqa: F401
    queries_model,
    queries_published,
    queries_relations,
    queries_reports,
    queries_statistics,
    queries_tables,
)
from pollspark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
