"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from logmill.plans import dashboards, detection, ingest, streams  # noqa: F401  they register their queries
from logmill.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
