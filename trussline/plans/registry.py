"""All registered queries and their SQL."""

from __future__ import annotations

from . import bundle_queries, drawing_queries, input_queries, model_queries, more_queries, store_queries, text_queries
from .views import with_views

_MODULES = (text_queries, drawing_queries, model_queries, more_queries, input_queries, store_queries, bundle_queries)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict = {name: with_views(sql) for m in _MODULES for name, sql in m.ORACLES.items()}
