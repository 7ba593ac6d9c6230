"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from speechprep.plans import media_queries, table_queries, text_queries

QUERIES = text_queries.QUERIES | table_queries.QUERIES | media_queries.QUERIES
ORACLES: dict[str, str] = text_queries.ORACLES | table_queries.ORACLES | media_queries.ORACLES
