"""All registered queries."""

from __future__ import annotations

from demandloom.plans import (  # noqa: F401
    queries_cleaning,
    queries_decisions,
    queries_kpi,
    queries_models,
    queries_orders,
    queries_quality,
    queries_series,
    queries_streams,
    queries_tables,
)
from demandloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
