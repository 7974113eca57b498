"""Names of the repository queries, their DataFrames and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from codestrata.plans import fact_queries, index_queries, parsed_queries, search_queries, signal_queries


def queries() -> dict[str, Callable]:
    return {**search_queries.QUERIES, **fact_queries.QUERIES, **parsed_queries.QUERIES, **index_queries.QUERIES, **signal_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**search_queries.SQL, **fact_queries.SQL, **parsed_queries.SQL, **index_queries.SQL, **signal_queries.SQL}
