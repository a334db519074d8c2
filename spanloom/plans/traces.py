"""Begin/end events to call statistics and critical paths, end to end."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import calls as ops
from ..operators.stacks import call_tree
from ..operators.storage import written


@dataclass
class TraceAnalysis:
    """Calls, statistics, hotspots and critical paths of recorded runs.

    The call tree comes from one ordered pass; it is written once where more than
    one consumer scans it.
    """

    events: DataFrame
    top_k: int = 10

    @cached_property
    def calls(self) -> DataFrame:
        """Completed calls with level, parent, self time, children and chain score."""
        return call_tree(self.events)

    @cached_property
    def stats(self) -> DataFrame:
        return written(self.calls, "call-stats")

    @cached_property
    def paths(self) -> DataFrame:
        return ops.critical_paths(self.stats, self.top_k)

    @cached_property
    def summary(self) -> DataFrame:
        return ops.run_summary(self.stats, self.paths, self.top_k)
