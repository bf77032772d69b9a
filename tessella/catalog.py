"""Queries over the driver's tables and their DuckDB oracles, gathered from the plan modules."""

from __future__ import annotations

from tessella.plans import q_graph, q_more, q_parse, q_plan, q_review, q_stream, q_text, q_vectors

PLANS = [q_vectors, q_review, q_text, q_graph, q_plan, q_stream, q_more, q_parse]


def queries() -> dict:
    return {name: f for m in PLANS for name, f in m.CATALOG.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in PLANS for name, sql in m.CATALOG.oracles.items()}
