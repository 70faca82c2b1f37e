"""Systems that update and evaluate themselves, walked over folds."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from chronofold.operators.reporting import json_ready
from chronofold.operators.runner import RetrainContext, RetrainPolicy, WalkForwardRunResult, policy_of, resolve_workflow
from chronofold.sources.adapters import coerce_tabular_input


@dataclass(frozen=True)
class SystemUpdateResult:
    state: Any
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class SystemEvaluationResult:
    metrics: dict[str, float]
    metadata: dict[str, Any] = field(default_factory=dict)


class UpdateableSystem(Protocol):
    """Both methods get DataFrames and may run jobs on them."""

    def update(self, train: DataFrame) -> SystemUpdateResult | object: ...

    def evaluate(self, state: Any, test: DataFrame) -> SystemEvaluationResult | Mapping[str, float]: ...


@dataclass
class SystemRunResult(WalkForwardRunResult):
    """Records have updated and last_update_fold; details has the metadata of each fold."""

    details: pd.DataFrame | None = None
    FLAG = "updated"

    @property
    def update_policy(self) -> str:
        return self.retrain_policy

    def update_events(self) -> DataFrame:
        return self.to_frame().where("updated")

    def evaluation_details(self) -> DataFrame:
        rows = [(r["fold"], r["updated"], {k: str(v) for k, v in r["update_metadata"].items()}, {k: str(v) for k, v in r["evaluation_metadata"].items()}) for r in self.details.to_dict("records")]
        return self.spark.createDataFrame(rows, "fold int, updated boolean, update_metadata map<string,string>, evaluation_metadata map<string,string>")

    def to_dict(self, **_) -> dict[str, object]:
        return json_ready({"summary": self.summary(), "folds": self.records.to_dict("records"), "details": self.details.to_dict("records")})


class TemporalSystemRunner:
    def __init__(self, *, system: UpdateableSystem, update: bool | str = True, update_interval: int | None = None, update_policy: RetrainPolicy | None = None, metric_directions: Mapping[str, str] | None = None, primary_metric: str | None = None):
        self.system, self.policy = system, policy_of(update, update_interval, update_policy)
        self.directions, self.primary = dict(metric_directions or {}), primary_metric

    def run(self, workflow, frame_input) -> SystemRunResult:
        plan = resolve_workflow(workflow, coerce_tabular_input(frame_input))
        records, details, state, last, update = [], [], None, None, SystemUpdateResult(None)
        for k, f in enumerate(plan.folds):
            split = plan.split_of(f)
            context = RetrainContext(f.iteration, split, pd.DataFrame(records), self.directions, last, self.primary)
            again = k == 0 or bool(self.policy.should_retrain(context))
            update = SystemUpdateResult(state)
            if again:
                found = self.system.update(split.segment("train"))
                update = found if isinstance(found, SystemUpdateResult) else SystemUpdateResult(found)
                state, last = update.state, f.iteration
            found = self.system.evaluate(state, split.segment("test"))
            if isinstance(found, Mapping):
                found = SystemEvaluationResult(dict(found))
            if not isinstance(found, SystemEvaluationResult):
                raise TypeError("evaluate() gives a SystemEvaluationResult or a mapping of metrics")
            if not found.metrics:
                raise ValueError("evaluate() gave no metrics")
            train, test = f.boundaries["train"], f.boundaries["test"]
            records.append({"fold": f.iteration, "updated": again, "last_update_fold": last, "train_rows": f.counts["train"], "test_rows": f.counts["test"], "train_start": train.start, "train_end": train.end, "test_start": test.start, "test_end": test.end} | {n: float(v) for n, v in found.metrics.items()})
            details.append({"fold": f.iteration, "updated": again, "update_metadata": update.metadata, "evaluation_metadata": found.metadata})
        names = tuple(dict.fromkeys(n for r in records for n in list(r)[9:]))
        if self.primary is not None and self.primary not in names:
            raise ValueError(f"primary metric {self.primary!r} is unknown")
        return SystemRunResult(pd.DataFrame(records), None, {n: self.directions.get(n, "min") for n in names}, type(self.policy).__name__, self.primary or names[0], names, plan.spark, pd.DataFrame(details))
