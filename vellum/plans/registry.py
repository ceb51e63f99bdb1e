"""All queries over the test tables, and their SQL."""

from __future__ import annotations

from vellum.plans.core import QUERIES
from vellum.plans.core_sql import SQL

__all__ = ["QUERIES", "SQL"]
