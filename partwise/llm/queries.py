"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from partwise.llm import table_queries, text_queries

QUERIES = {**table_queries.QUERIES, **text_queries.QUERIES}
SQL = {**table_queries.SQL, **text_queries.SQL}
