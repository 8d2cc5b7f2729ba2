"""Registered queries: every operator on the shared test tables, with its SQL twin."""

from . import aggregates, forecasts, frames, learned, scans  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
