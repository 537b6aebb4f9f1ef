"""All queries of this package and their SQL."""

from __future__ import annotations

from quire.llm import components, language, leakage, lookalike, names, packing, scan_noise, shared_spans

MODULES = [components, language, leakage, lookalike, names, packing, scan_noise, shared_spans]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
