"""All queries of the core and their SQL."""

from __future__ import annotations

from quire.operators import orphans
from quire.plans import archive, canned, citations, flags, layout, links, quality, texts
from quire.streaming import windows

MODULES = [citations, canned, texts, links, layout, archive, quality, flags, windows, orphans]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
