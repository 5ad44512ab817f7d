"""All registered queries of the library and their SQL, by module."""

from __future__ import annotations


def _modules() -> list:
    from lumenforge.plans import attribution_queries, behaviour_queries, catalogue_queries, experiment_queries, learning_queries, remaining_queries, request_queries, retrieval_queries, source_queries, stream_queries, text_queries

    return [request_queries, behaviour_queries, retrieval_queries, catalogue_queries, experiment_queries, text_queries, learning_queries, stream_queries, source_queries, attribution_queries, remaining_queries]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLE_SQL.items()}
