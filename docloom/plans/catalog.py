"""All queries and their SQL."""

from docloom.plans import evaluation_queries, file_queries, hierarchy_queries, register_queries, search_queries, text_queries

_MODULES = (search_queries, text_queries, hierarchy_queries, register_queries, evaluation_queries, file_queries)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
