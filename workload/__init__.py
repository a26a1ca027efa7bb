"""Queries over the driver tables, each with an equivalent SQL text where one exists."""

from workload import cohorts, groups, jobs, reports, rows, stats, whole  # noqa: F401  (register on import)
from workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
