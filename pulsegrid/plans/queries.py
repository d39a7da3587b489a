"""All registered signal queries."""

from __future__ import annotations

from pulsegrid.plans import event_queries, marker_queries, spectral_queries, stats_queries, stream_queries, surface_queries, tag_queries, view_queries  # noqa: F401
from pulsegrid.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
