"""Queries: the operators bound to the driver's tables."""

from . import aggregates, extensions, graphs, joins, live, projections
from .base import ORACLES, PLANS

__all__ = ["ORACLES", "PLANS", "aggregates", "extensions", "graphs", "joins", "live", "projections"]
