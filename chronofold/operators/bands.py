"""Prediction bands by fold: user code estimates them per fold, their widths and coverage are aggregates."""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.metrics import EvaluationProfile
from chronofold.operators.reporting import json_ready
from chronofold.operators.runner import FoldRuns, resolve_workflow
from chronofold.sources.adapters import coerce_tabular_input


@dataclass(frozen=True)
class PredictionBandContext:
    """What a band estimator sees of one fold, in a Python worker."""

    fold: int
    model: object
    X_train: pd.DataFrame
    y_train: pd.Series
    X_test: pd.DataFrame
    y_test: pd.Series
    predictions: np.ndarray
    metadata: dict = field(default_factory=dict)


@dataclass
class PredictionBandScenarioResult:
    records: DataFrame
    predictions: DataFrame
    artifacts: DataFrame

    def to_frame(self) -> DataFrame:
        return self.records

    def predictions_frame(self) -> DataFrame:
        return self.predictions

    def artifacts_frame(self) -> DataFrame:
        return self.artifacts

    def band_summary(self) -> DataFrame:
        """Mean over folds of width and coverage."""
        return self.records.agg(F.count("*").alias("total_folds"), F.avg("prediction_band_width_mean").alias("mean_width"), F.avg("prediction_band_width_median").alias("mean_median_width"), F.avg("prediction_band_coverage").alias("mean_coverage"))

    def to_dict(self, *, include_predictions: bool = False, include_artifacts: bool = False) -> dict[str, object]:
        out = {"summary": self.band_summary().first().asDict(), "folds": [r.asDict() for r in self.records.orderBy("fold").collect()]}
        if include_predictions:
            out["predictions"] = [r.asDict() for r in self.predictions.collect()]
        if include_artifacts:
            out["artifacts"] = [r.asDict() for r in self.artifacts.collect()]
        return json_ready(out)


def _checked(found, n: int) -> tuple[np.ndarray, np.ndarray, dict]:
    if not hasattr(found, "keys") or not {"lower", "upper"} <= set(found.keys()):
        raise ValueError("a band has lower and upper")
    low, high = (np.asarray(found[k], float) for k in ("lower", "upper"))
    if low.ndim != 1 or high.ndim != 1:
        raise ValueError("lower and upper have one dimension")
    if len(low) != n or len(high) != n:
        raise ValueError("lower and upper are as long as the predictions")
    if (low > high).any():
        raise ValueError("lower is above upper")
    return low, high, {k: v for k, v in found.items() if k not in ("lower", "upper")}


def estimate_prediction_band_by_fold(workflow, X, *, model, target_col, band_estimator, feature_cols: Sequence | None = None, metrics=None, time_col=None, key_col: str | None = None, prediction_column: str = "prediction") -> PredictionBandScenarioResult:
    """Bands of every fold: each fold is one group that is fitted, predicted and given to the estimator (an object with estimate(context), or a function)."""
    estimate: Callable = band_estimator.estimate if hasattr(band_estimator, "estimate") else band_estimator
    if not callable(estimate):
        raise TypeError("a band estimator has estimate(context) or can be called")
    df = coerce_tabular_input(X)
    plan = resolve_workflow(workflow, df)
    runs = FoldRuns(plan, model, target_col, feature_cols, EvaluationProfile(metrics).resolve(), key_col)
    target, features = runs.target, runs.features
    id_kind = dict(runs.rows.dtypes)["_cf_row"]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        train, test = (group[group["_cf_segment"] == s].sort_values("_cf_row") for s in ("train", "test"))
        own = copy.deepcopy(model)
        own = own.fit(train[features], train[target]) or own
        p = np.asarray(own.predict(test[features]), float)
        fold = int(group["_cf_k"].iloc[0])
        low, high, more = _checked(estimate(PredictionBandContext(fold, own, train[features], train[target], test[features], test[target], p)), len(test))
        out = pd.DataFrame({"k": fold, "row_id": test["_cf_row"], "y": test[target].astype(float), "p": p, "low": low, "high": high})
        out["artifacts"] = [{}] * len(out)
        if len(out):
            out.iat[0, out.columns.get_loc("artifacts")] = {str(k): str(v) for k, v in more.items()}
        return out

    both = runs.rows.where(F.col("_cf_segment").isin("train", "test"))
    scored = both.groupBy("_cf_k").applyInPandas(one, f"k int, row_id {id_kind}, y double, p double, low double, high double, artifacts map<string,string>")
    folds = plan.spark.createDataFrame([(k, f.iteration, f.counts["train"], f.counts["test"]) for k, f in enumerate(plan.folds)], "k int, fold int, train_rows long, test_rows long")
    width = F.col("high") - F.col("low")
    extra = [f(F.col("y"), F.col("p")).alias(n) for n, f in runs.profile.metrics.items() if runs.profile.native[n]]
    stats = scored.groupBy("k").agg(F.avg(width).alias("prediction_band_width_mean"), F.median(width).alias("prediction_band_width_median"), F.avg(F.col("y").between(F.col("low"), F.col("high")).cast("double")).alias("prediction_band_coverage"), *extra)
    records = folds.join(stats, "k").drop("k")
    predictions = scored.join(F.broadcast(folds), "k").select("fold", F.col("row_id").alias("row_index"), F.col("y").alias("y_true"), F.col("p").alias(prediction_column), F.col("low").alias("prediction_lower"), F.col("high").alias("prediction_upper"), width.alias("prediction_band_width"))
    artifacts = scored.join(F.broadcast(folds), "k").select("fold", F.explode("artifacts").alias("artifact", "value"))
    return PredictionBandScenarioResult(records, predictions, artifacts)
