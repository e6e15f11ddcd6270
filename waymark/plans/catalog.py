"""The catalogue of core queries."""

from __future__ import annotations

from waymark.plans import build_queries, context_queries, extract_queries, ops_queries, quality_queries, search_queries, skew_queries, usage_queries
from waymark.registry import Registry

CORE = Registry()
for part in (search_queries, context_queries, extract_queries, build_queries, quality_queries, usage_queries, ops_queries, skew_queries):
    part.register(CORE)
