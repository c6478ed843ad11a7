"""Whole workloads, and the registered queries with their SQL equivalents."""

from paperlake.plans import more_queries
from paperlake.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "more_queries"]
