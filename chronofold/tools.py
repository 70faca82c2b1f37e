"""Plain functions for agents: each takes a path or a DataFrame and JSON-like settings, and gives dicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from chronofold.functions.metrics import MajorityModel, MeanModel
from chronofold.operators.reporting import json_ready
from chronofold.operators.runner import AlwaysRetrain, FoldRuns, NeverRetrain, PeriodicRetrain, WalkForwardRunner
from chronofold.operators.splitting import SimulationCampaign, SimulationVariant, WalkForwardPolicy
from chronofold.operators.studies import DriftMonitoringPolicy, TrainHistoryPolicy
from chronofold.plans.plan import diagnose, summarize
from chronofold.plans.spec import TemporalPartitionSpec
from chronofold.sources import profiling
from chronofold.sources.readers import load_dataset_frame, preview_dataset


def _table(spark: SparkSession, source, dataset_format: str = "auto") -> DataFrame:
    return source if isinstance(source, DataFrame) else load_dataset_frame(spark, source, dataset_format)


def _policy(time_col, partition, step=None, strategy: str = "rolling", allow_partial: bool = False, start_at=None, end_at=None, max_folds=None, keys=()) -> WalkForwardPolicy:
    spec = partition if isinstance(partition, TemporalPartitionSpec) else TemporalPartitionSpec(**partition)
    return WalkForwardPolicy(time_col=time_col, partition=spec, step=step, strategy=strategy, allow_partial=allow_partial, start_at=start_at, end_at=end_at, max_folds=max_folds, keys=keys)


def _baseline(model: str):
    if model not in ("mean", "majority_class"):
        raise ValueError("a baseline is mean or majority_class")
    return (MeanModel(), ["mae", "rmse"]) if model == "mean" else (MajorityModel(), ["accuracy"])


def preview_local_dataset(spark, path: str, sample_rows: int = 5):
    return json_ready(preview_dataset(spark, path, sample_rows))


def inspect_local_dataset(spark, source, sample_rows: int | None = 5_000, preview_rows: int = 5, full_scan: bool = False):
    """Profiles and candidates from the first rows, or with full_scan from all."""
    return json_ready(profiling.inspect_dataset(_table(spark, source), preview_rows=preview_rows, sample_rows=None if full_scan else sample_rows))


def suggest_temporal_partition_policy(spark, source, time_col: str | None = None, objective: str = "walk_forward"):
    return json_ready(profiling.suggest_partition_policy(_table(spark, source), time_col, objective))


def inspect_and_recommend_local_dataset(spark, source, objective: str = "walk_forward", sample_rows: int | None = 5_000, full_scan: bool = False):
    df = _table(spark, source)
    found = profiling.inspect_dataset(df, sample_rows=None if full_scan else sample_rows)
    first = found["time_candidates"][0]["name"] if found["time_candidates"] else None
    return json_ready(found | {"recommendation": profiling.suggest_partition_policy(df, first, objective) if first else None})


def validate_temporal_partition_policy(spark, source, **policy):
    plan = _policy(**policy).plan(_table(spark, source))
    return json_ready(diagnose(plan) | {"summary": summarize(plan)})


def compare_temporal_partition_strategies(spark, source, policies: dict[str, dict]):
    df = _table(spark, source)
    return {name: validate_temporal_partition_policy(spark, df, **p) for name, p in policies.items()}


def plan_walk_forward_simulation(spark, source, preview: int | None = None, **policy):
    plan = _policy(**policy).plan(_table(spark, source))
    return json_ready({"total_folds": len(plan), "summary": summarize(plan), "folds": [f.to_dict() for f in plan.folds[:preview]]})


def run_walk_forward_simulation(spark, source, title: str | None = None, **policy):
    return json_ready(_policy(**policy).run(_table(spark, source), title).to_dict())


def run_simulation_campaign(spark, source, variants: dict[str, dict], max_workers: int | None = None):
    campaign = SimulationCampaign([SimulationVariant(n, _policy(**p)) for n, p in variants.items()])
    return json_ready([r.asDict() for r in campaign.run(_table(spark, source), max_workers).to_frame().collect()])


def run_walk_forward_baseline_model(spark, source, target_col: str, model: str = "mean", retrain="always", retrain_interval=None, metrics: Sequence[str] | None = None, **policy):
    df = _table(spark, source)
    native, own = _baseline(model)
    features = [c for c in df.columns if c not in (target_col, policy["time_col"])][:1] or [target_col]
    runner = WalkForwardRunner(model=native, target_col=target_col, feature_cols=features, retrain=retrain, retrain_interval=retrain_interval, metrics=list(metrics or own), include_predictions=False)
    return runner.run(_policy(**policy), df).to_dict()


def compare_retrain_policy_baselines(spark, source, target_col: str, model: str = "mean", policies: dict[str, object] | None = None, **policy):
    """All policies from the same losses, a job for each block of folds."""
    df = _table(spark, source)
    native, own = _baseline(model)
    from chronofold.functions.metrics import EvaluationProfile

    plan = _policy(**policy).plan(df)
    features = [c for c in df.columns if c not in (target_col, policy["time_col"])][:1] or [target_col]
    runs = FoldRuns(plan, native, target_col, features, EvaluationProfile(own).resolve())
    out = {}
    for name, p in (policies or {"always": AlwaysRetrain(), "never": NeverRetrain(), "periodic_2": PeriodicRetrain(2)}).items():
        schedule, found = runs.replay(p)
        values = {m: [row[m] for row in found.values()] for m in own}
        out[name] = {"retrains": sum(schedule), "metrics": {m: sum(v) / len(v) for m, v in values.items()}}
    return json_ready(out)


def find_train_history_window_baseline(spark, source, target_col: str, time_col: str, cutoff, train_sizes, test_size, gap_before_test=None, model: str = "mean", metric: str | None = None, tolerance: float = 0.0, relative: bool = True):
    df = _table(spark, source)
    native, own = _baseline(model)
    result = TrainHistoryPolicy(time_col, cutoff=cutoff, train_sizes=train_sizes, test_size=test_size, gap_before_test=gap_before_test, metric_directions={"accuracy": "max"} if model != "mean" else None).evaluate(df, model=native, target_col=target_col, feature_cols=[target_col], metrics=own)
    return json_ready({"records": result.records.to_dict("records"), "optimal": result.find_optimal_train_size(metric=metric or own[0], tolerance=tolerance, relative=relative)})


def monitor_decay_baseline(spark, source, target_col: str, time_col: str, cutoff, train_size, test_size, step, gap_before_test=None, max_windows=None, model: str = "mean", metric: str | None = None, threshold: float = 0.1, baseline="first", relative: bool = True):
    df = _table(spark, source)
    native, own = _baseline(model)
    result = DriftMonitoringPolicy(time_col, cutoff=cutoff, train_size=train_size, test_size=test_size, step=step, gap_before_test=gap_before_test, max_windows=max_windows).evaluate(df, model=native, target_col=target_col, feature_cols=[target_col], metrics=own)
    return json_ready({"records": result.records.to_dict("records"), "onset": result.find_drift_onset(metric=metric or own[0], threshold=threshold, baseline=baseline, relative=relative)})
