"""All queries of the core and their SQL."""

from __future__ import annotations

from equarry.plans import case_queries, corpus_queries, graph_queries, orphan_queries, retrieval_queries, stream_queries

_MODULES = (corpus_queries, case_queries, retrieval_queries, graph_queries, orphan_queries, stream_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
