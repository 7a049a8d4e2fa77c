"""Catalogue of the engine's queries and their SQL counterparts."""

from __future__ import annotations

from epochlens.plans import extracts, feeds, history, leaks, measures, orders, reactions, reads, state, stores, streams, studies, texts  # noqa: F401  (they register their queries)
from epochlens.plans.registry import ORACLE_SQL, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
