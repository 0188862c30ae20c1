"""Every registered query of the monitoring operators, with its SQL."""

from __future__ import annotations

from . import drift_queries, series_queries, table_queries  # noqa: F401
from .base import ORACLES, QUERIES

FLAGSHIP = "DR16_catdrift_predict"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
