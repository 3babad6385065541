"""All registered queries of the engine, and their SQL twins."""

from __future__ import annotations

from .plans import detail_queries, model_queries, network_queries, quality_queries, report_queries, separation_queries, session_queries, signal_queries, stat_queries, stream_queries, window_queries  # noqa: F401
from .plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
