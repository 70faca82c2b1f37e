"""Plans: fold boundaries and row counts, before any row is taken."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from chronofold.plans.spec import SegmentBoundaries, instant_us


@dataclass(frozen=True)
class PlannedFold:
    iteration: int
    boundaries: dict[str, SegmentBoundaries]
    counts: dict[str, int]
    bounds: dict[str, tuple[int, int]]  # microseconds, or positions
    metadata: dict[str, object] = field(default_factory=dict)

    @property
    def fold(self) -> int:
        return self.iteration

    @property
    def is_partial(self) -> bool:
        return bool(self.metadata.get("is_partial"))

    @property
    def simulation_start(self) -> dt.datetime:
        return min(b.start for b in self.boundaries.values())

    @property
    def simulation_end(self) -> dt.datetime:
        return max(b.end for b in self.boundaries.values())

    def to_dict(self) -> dict[str, object]:
        out = {"iteration": self.iteration, "fold": self.iteration, "simulation_start": self.simulation_start, "simulation_end": self.simulation_end, "is_partial": self.is_partial}
        for name, b in self.boundaries.items():
            out |= {f"{name}_start": b.start, f"{name}_end": b.end, f"{name}_rows": self.counts[name]}
        return out


def plan_schema(segments: Sequence[str]) -> str:
    own = ", ".join(f"{s}_start timestamp_ntz, {s}_end timestamp_ntz, {s}_rows long" for s in segments)
    return f"iteration int, fold int, simulation_start timestamp_ntz, simulation_end timestamp_ntz, is_partial boolean, {own}"


@dataclass(frozen=True)
class PartitionPlan:
    """Folds of a plan, with what turns one into its rows."""

    spark: SparkSession
    folds: tuple[PlannedFold, ...]
    segments: tuple[str, ...]
    size_kind: str
    strategy: str
    split_of: Callable[[PlannedFold], object]
    summary_of: Callable[[Sequence[PlannedFold], str | None], object]
    title: str | None = None

    @property
    def total_folds(self) -> int:
        return len(self.folds)

    def __len__(self) -> int:
        return len(self.folds)

    def to_frame(self) -> DataFrame:
        rows = [tuple(f.to_dict().values()) for f in self.folds]
        return self.spark.createDataFrame(rows, plan_schema(self.segments))

    def _where(self, keep: Callable[[PlannedFold], bool]) -> PartitionPlan:
        return replace(self, folds=tuple(f for f in self.folds if keep(f)))

    def select_iterations(self, iterations: Sequence[int]) -> PartitionPlan:
        wanted = set(iterations)
        return self._where(lambda f: f.iteration in wanted)

    def select_from_iteration(self, iteration: int) -> PartitionPlan:
        return self._where(lambda f: f.iteration >= iteration)

    def select_until_iteration(self, iteration: int) -> PartitionPlan:
        return self._where(lambda f: f.iteration <= iteration)

    def exclude_windows(self, *, train=None, validation=None, test=None) -> PartitionPlan:
        """Without the folds of which a segment overlaps one of the windows given for it; numbers stay."""
        out = self
        for name, windows in (("train", train), ("validation", validation), ("test", test)):
            spans = [(instant_us(a), instant_us(b)) for a, b in windows or ()]
            if any(b <= a for a, b in spans):
                raise ValueError("a window must end after it starts")
            if spans and name in self.segments:
                out = out._where(lambda f, n=name, s=spans: not any(instant_us(f.boundaries[n].start) < b and instant_us(f.boundaries[n].end) > a for a, b in s))
        return out

    def iter_splits(self) -> Iterator[object]:
        for f in self.folds:
            yield self.split_of(f)

    def materialize(self):
        """The folds as a simulation result; by position where the plan is by position."""
        if not self.folds:
            raise ValueError("the plan has no folds")
        return self.summary_of(self.folds, self.title)

    def describe(self):
        return self.materialize().summary


#: A plan of a simulation has the same methods.
SimulationPlan = PartitionPlan


def diagnose(plan: PartitionPlan, least_train: int = 10, least_test: int = 5) -> dict[str, object]:
    """What is wrong with a plan (issues) and what is merely worth a look (warnings): every fold of it is looked at."""
    folds = plan.folds
    if not folds:
        return {"valid": False, "total_folds": 0, "issues": ["the policy gives no folds"], "warnings": []}
    issues = [f"{s} is empty in some fold" for s in plan.segments if any(f.counts[s] <= 0 for f in folds)]
    edges = [(f.boundaries["train"].end, f.boundaries["test"].start) for f in folds if {"train", "test"} <= set(f.boundaries)]
    if any(start < end for end, start in edges):
        issues.append("test starts before train ends in some fold")
    warnings = ["some folds are partial"] if any(f.is_partial for f in folds) else []
    if any(start == end for end, start in edges):
        warnings.append("test starts at the instant that train ends in some fold")
    for segment, least in (("train", least_train), ("test", least_test)):
        if any(f.counts.get(segment, least) < least for f in folds):
            warnings.append(f"{segment} has fewer than {least} rows in some fold")
    return {"valid": not issues, "total_folds": len(folds), "issues": issues, "warnings": warnings}


def summarize(plan: PartitionPlan) -> dict[str, object]:
    """Least, greatest and mean rows of each segment, and the span."""
    if not plan.folds:
        return {"total_folds": 0}
    rows = {s: [f.counts[s] for f in plan.folds] for s in plan.segments}
    return {
        "total_folds": len(plan.folds),
        "simulation_start": min(f.simulation_start for f in plan.folds),
        "simulation_end": max(f.simulation_end for f in plan.folds),
        "rows": {s: {"min": min(n), "max": max(n), "mean": sum(n) / len(n)} for s, n in rows.items()},
    }
