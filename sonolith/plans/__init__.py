"""Queries by name, and the planner that fuses what a chain of operations does."""

from __future__ import annotations

from .registry import ORACLES, QUERIES, Query


def _load() -> None:
    from . import effect_queries, event_queries, signal_queries, stream_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
