"""All queries over the library's own operators, and their SQL."""

from __future__ import annotations

from . import collection_queries, graph_queries, table_queries, text_queries

QUERIES = {**text_queries.QUERIES, **table_queries.QUERIES, **graph_queries.QUERIES, **collection_queries.QUERIES}
ORACLES = {**text_queries.ORACLES, **table_queries.ORACLES, **graph_queries.ORACLES, **collection_queries.ORACLES}
