"""All queries of the engine by name, and their SQL oracles."""

from __future__ import annotations

from codestrata.plans import graph_queries, source_queries, table_queries, tool_queries  # noqa: F401  they register themselves
from codestrata.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
