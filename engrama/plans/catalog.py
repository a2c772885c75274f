"""All registered queries: importing this module registers them."""

from __future__ import annotations

from engrama.plans import detail_queries, federated_queries, graph_queries, memory_queries, text_queries
from engrama.plans.registry import ORACLES, QUERIES

MODULES = (text_queries, graph_queries, memory_queries, federated_queries, detail_queries)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
