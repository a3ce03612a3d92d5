"""All registered queries."""

from stratocast.plans import cleaning_queries, forecast_queries, panel_queries, report_queries, wide_queries  # noqa: F401
from stratocast.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
