"""All queries of the core. Importing the modules registers them."""

from cairnwork.plans import analytics, evidence_queries, graph_queries, incremental_queries, lens, more_queries, ownership_queries, problems, relational, reports, snapshot_reports, sqlapi  # noqa: F401
from cairnwork.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
