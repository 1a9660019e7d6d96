"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import feature_queries, model_queries, queries

MODULES = (queries, feature_queries, model_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
