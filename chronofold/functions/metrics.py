"""Metrics and native model states as column expressions, and the profile that resolves them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aggregates over the columns y and p.
NAMED: dict[str, tuple[Callable[[Column, Column], Column], str]] = {
    "mae": (lambda y, p: F.avg(F.abs(y - p)), "min"),
    "mse": (lambda y, p: F.avg((y - p) * (y - p)), "min"),
    "rmse": (lambda y, p: F.sqrt(F.avg((y - p) * (y - p))), "min"),
    "rmspe": (lambda y, p: F.sqrt(F.avg(F.when(y != 0, F.pow((y - p) / y, 2)))), "min"),
    "bias": (lambda y, p: F.avg(p - y), "min"),
    "accuracy": (lambda y, p: F.avg((y == p).cast("double")), "max"),
    "ordinal_cost": (lambda y, p: F.avg(F.abs(y.cast("double") - p.cast("double"))), "min"),
}


@dataclass(frozen=True)
class ResolvedEvaluationProfile:
    metrics: dict[str, object]  # name -> function of columns (y, p), or a Python callable (y_true, y_pred)
    native: dict[str, bool]
    directions: dict[str, str]
    primary_metric: str | None


@dataclass(frozen=True)
class EvaluationProfile:
    """Metrics by name, as a column aggregate `Metric(f)`, or as a Python callable of (y_true, y_pred); directions are min or max."""

    metrics: object = None
    metric_directions: Mapping[str, str] | None = None
    primary_metric: str | None = None

    def resolve(self) -> ResolvedEvaluationProfile:
        given = normalize_metrics(self.metrics)
        found, native, directions = {}, {}, {}
        for name, m in given.items():
            if isinstance(m, Metric):
                found[name], native[name], directions[name] = m.function, True, m.direction
            elif callable(m):
                found[name], native[name], directions[name] = m, False, "min"
            else:
                raise TypeError(f"metric {name!r} can't be called")
        for name, d in (self.metric_directions or {}).items():
            if d not in ("min", "max"):
                raise ValueError("a direction is min or max")
            if name not in found:
                raise ValueError(f"direction of an unknown metric {name!r}")
            directions[name] = d
        primary = self.primary_metric or next(iter(found), None)
        if self.primary_metric is not None and self.primary_metric not in found:
            raise ValueError(f"primary metric {self.primary_metric!r} is unknown")
        return ResolvedEvaluationProfile(found, native, directions, primary)


@dataclass(frozen=True)
class Metric:
    """A metric as an aggregate of the columns y and p."""

    function: Callable[[Column, Column], Column]
    direction: str = "min"


def normalize_metrics(metrics) -> dict[str, object]:
    if metrics is None:
        return {}
    if isinstance(metrics, str):
        metrics = [metrics]
    if isinstance(metrics, Sequence):
        metrics = {m if isinstance(m, str) else getattr(m, "__name__", str(m)): m for m in metrics}
    if callable(metrics) and not isinstance(metrics, Mapping):
        metrics = {getattr(metrics, "__name__", "metric"): metrics}
    if not metrics:
        raise ValueError("metrics are empty; give None for no metrics")
    out = {}
    for name, m in metrics.items():
        if isinstance(m, str):
            if m not in NAMED:
                raise ValueError(f"no metric named {m!r}")
            m = Metric(*NAMED[m])
        out[name] = m
    return out


class RegressionProfile(EvaluationProfile):
    def __init__(self, metrics=("rmse", "mae"), metric_directions=None, primary_metric=None):
        super().__init__(metrics, metric_directions, primary_metric)


class ClassificationProfile(EvaluationProfile):
    def __init__(self, metrics=("accuracy",), metric_directions=None, primary_metric=None):
        super().__init__(metrics, metric_directions, primary_metric)


class OrdinalClassificationProfile(EvaluationProfile):
    def __init__(self, metrics=("ordinal_cost", "accuracy"), metric_directions=None, primary_metric=None):
        super().__init__(metrics, metric_directions, primary_metric)


class RankingProfile(EvaluationProfile):
    def __init__(self, metrics=None, metric_directions=None, primary_metric=None):
        super().__init__(metrics, metric_directions, primary_metric)


class NativeModel:
    """A model whose state is an aggregate: state() over training rows grouped by some keys, predict() as a column over a row joined to its state."""

    keys: tuple[str, ...] = ()

    def state(self, target: str, features: Sequence[str]) -> list[Column]:
        raise NotImplementedError

    def predict(self, features: Sequence[str]) -> Column:
        raise NotImplementedError

    def ready(self, df: DataFrame, target: str) -> DataFrame:
        return df


class MeanModel(NativeModel):
    """The mean of the target; what isn't a number counts as missing."""

    def state(self, target, features):
        return [F.avg(F.expr(f"try_cast(`{target}` AS DOUBLE)")).alias("_cf_mean")]

    def predict(self, features):
        return F.col("_cf_mean")


class MajorityModel(NativeModel):
    """The most frequent value of the target; the least of ties."""

    def state(self, target, features):
        return [F.mode(F.col(f"`{target}`"), deterministic=True).alias("_cf_mode")]

    def predict(self, features):
        return F.col("_cf_mode")


class LinearModel(NativeModel):
    """Least squares on one feature."""

    def state(self, target, features):
        y, x = (F.col(f"`{c}`").cast("double") for c in (target, features[0]))
        return [F.regr_slope(y, x).alias("_cf_slope"), F.regr_intercept(y, x).alias("_cf_intercept")]

    def predict(self, features):
        return F.col("_cf_slope") * F.col(f"`{features[0]}`").cast("double") + F.col("_cf_intercept")


class GroupMedianModel(NativeModel):
    """The median of the target within each group of key columns; for a group without rows, the median of all."""

    def __init__(self, *keys: str):
        self.keys = keys

    def state(self, target, features):
        return [F.median(F.col(f"`{target}`").cast("double")).alias("_cf_median")]

    def predict(self, features):
        return F.coalesce(F.col("_cf_median"), F.col("_cf_all"))
