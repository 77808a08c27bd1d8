"""All queries for the reference's own operators, with their SQL."""

from __future__ import annotations

from lookalike.plans import catalog_queries, cluster_queries, similarity_queries, stream_queries

_PARTS = (catalog_queries, similarity_queries, cluster_queries, stream_queries)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.Q.items()}
SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.SQL.items()}
