"""Imports every query module so that the registry is complete."""

from tidemark.plans import docs, governance, graphs, history, reports, signals  # noqa: F401
from tidemark.plans.catalog import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
