"""All queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from tessella.llm import q_classify, q_leaks, q_mix, q_near, q_pages, q_scan, q_select

MODULES = [q_pages, q_scan, q_leaks, q_near, q_classify, q_mix, q_select]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
