"""Registered queries."""

from . import corridor_queries, display_queries, feed_queries, line_graph_queries, line_queries, merge_queries, record_queries, route_queries, sensor_queries, store_queries, stuck_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
