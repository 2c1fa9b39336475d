"""All queries of the library, by name, and their SQL twins."""

from __future__ import annotations

from attesta.plans import answer_queries, extra_queries, lexical_queries, quality_queries, retrieval_queries, study_queries

_PARTS = (lexical_queries, retrieval_queries, study_queries, answer_queries, extra_queries, quality_queries)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
SQL = {k: v for part in _PARTS for k, v in part.SQL.items()}
