"""Queries over the driver's tables, and SQL for their rows."""

from __future__ import annotations

from . import ingest_queries, planning_queries, point_queries, session_queries, source_queries, statistics_queries, stream_queries  # noqa: F401  they register themselves
from .register import ORACLES, QUERIES, Query


def all_queries() -> dict[str, Query]:
    return QUERIES


def all_oracles() -> dict[str, str]:
    return ORACLES
