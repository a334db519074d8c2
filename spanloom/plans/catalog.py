"""All registered queries."""

from __future__ import annotations

from . import (  # noqa: F401
    queries_groups,
    queries_increments,
    queries_native,
    queries_ranking,
    queries_regression,
    queries_results,
    queries_runs,
    queries_sources,
    queries_traces,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
