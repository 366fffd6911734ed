"""Registered queries and their SQL."""

from __future__ import annotations

from .plans import channel_queries, epoch_queries, event_queries, spectral_queries

MODULES = (event_queries, channel_queries, epoch_queries, spectral_queries)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
