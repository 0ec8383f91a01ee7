"""All queries of the speech operators, and the SQL that checks them."""

from __future__ import annotations

from . import feature_queries, model_queries, pipe_queries, signal_queries, spectral_queries

_PARTS = (signal_queries, spectral_queries, feature_queries, model_queries, pipe_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
