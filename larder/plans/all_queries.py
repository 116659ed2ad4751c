"""All registered queries of the engine, and their SQL."""

from __future__ import annotations

from . import coverage_queries, prompt_queries, queries, retrieval_queries

_PARTS = (queries, retrieval_queries, prompt_queries, coverage_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
