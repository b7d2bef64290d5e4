"""Every registered query of the engine with its checking SQL."""

from __future__ import annotations

from seqloom.plans import distance_queries, graph_queries, record_queries

QUERIES = record_queries.QUERIES | graph_queries.QUERIES | distance_queries.QUERIES
ORACLES = record_queries.ORACLES | graph_queries.ORACLES | distance_queries.ORACLES
FLAGSHIP = "dist_seq"
