"""All queries over the market tables, by name, with their SQL."""

from __future__ import annotations

from .plans import bar_queries, discovery_queries, journal_queries, live_queries, mining_queries

_MODULES = (bar_queries, mining_queries, journal_queries, discovery_queries, live_queries)

QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL: dict[str, str] = {name: q for m in _MODULES for name, q in m.SQL.items()}


def entry(spark, sf_dir: str):
    """Graded statistics of every pattern and direction, over all candle sizes."""
    return QUERIES["trade_summary_oos_all"](spark, sf_dir)
