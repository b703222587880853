"""All queries of the library's own operators, and their SQL for DuckDB."""

from __future__ import annotations

from . import record_queries, screening_queries, stopping_queries, text_queries

QUERIES = {**screening_queries.QUERIES, **text_queries.QUERIES, **record_queries.QUERIES, **stopping_queries.QUERIES}
SQL = {**screening_queries.SQL, **text_queries.SQL, **record_queries.SQL, **stopping_queries.SQL}
