"""Studies of one question: how much history is enough, when a fitted state decays, and both over time."""

from __future__ import annotations

import copy
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from statistics import mean, median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.metrics import EvaluationProfile, NativeModel
from chronofold.functions.timeline import as_time, at, named, table, us
from chronofold.operators.runner import features_of, worsened
from chronofold.operators.splitting import WalkForwardPolicy, meet
from chronofold.plans.spec import SizeSpec, TemporalSemanticsSpec, duration_us, instant, instant_us
from chronofold.sources.adapters import coerce_tabular_input


@dataclass
class _Records:
    records: pd.DataFrame
    metric_directions: Mapping[str, str]
    spark: object = None

    def to_frame(self) -> DataFrame:
        return table(self.spark, self.records)

    def _metric(self, metric: str) -> bool:
        if metric not in self.records:
            raise ValueError(f"no metric {metric!r}")
        return self.metric_directions.get(metric, "min") == "max"


@dataclass
class TrainGrowthResult(_Records):
    def find_optimal_train_size(self, *, metric: str = "rmse", tolerance: float = 0.0, relative: bool = True) -> dict[str, object]:
        """The variant with the fewest train rows of those within a tolerance of the best; then the better metric, then the first."""
        largest = self._metric(metric)
        rows = self.records.dropna(subset=[metric])
        best = rows[metric].max() if largest else rows[metric].min()
        sign = -1 if largest else 1
        limit = best * (1 + sign * tolerance) if relative else best + sign * tolerance
        rows = rows[rows[metric] >= limit] if largest else rows[rows[metric] <= limit]
        if not len(rows):
            raise ValueError("no train size is within the tolerance")
        key = rows.assign(_m=rows[metric] * sign).sort_values(["train_rows", "_m", "variant"], kind="stable")
        return key.drop(columns="_m").iloc[0].to_dict()


@dataclass
class PerformanceDecayResult(_Records):
    def find_drift_onset(self, *, metric: str = "rmse", threshold: float = 0.1, baseline: str | float = "first", relative: bool = True) -> dict[str, object] | None:
        """The first window whose metric is worse than the baseline by the threshold."""
        if threshold < 0:
            raise ValueError("threshold must not be negative")
        largest = self._metric(metric)
        values = self.records[metric]
        if isinstance(baseline, str):
            if baseline not in ("first", "best"):
                raise ValueError("baseline is first, best or a number")
            base = values.iloc[0] if baseline == "first" else values.max() if largest else values.min()
        else:
            base = float(baseline)
        flagged = self.records[[worsened(v, base, threshold, largest, relative) for v in values]]
        return None if not len(flagged) else flagged.sort_values("window").iloc[0].to_dict()


class _Windows:
    """Fits on windows of time and predicts others, all in one job: windows are a small table, rows meet those of their own grid cell."""

    def __init__(self, df: DataFrame, semantics: TemporalSemanticsSpec, model, target_col, feature_cols, metrics, metric_directions=None):
        self.df, self.semantics, self.model = df, semantics, model
        self.target, self.features = features_of(df, target_col, feature_cols, semantics)
        self.profile = EvaluationProfile(metrics, metric_directions).resolve()

    def time(self, segment: str):
        return as_time(self.df, self.semantics.column_for_segment(segment))

    def rows(self, segment: str, windows: list[tuple[int, int, int]]) -> DataFrame:
        """Rows with the number of each window (number, from, to) that they lie in."""
        time = self.time(segment)
        low, high = min(w[1] for w in windows), max(w[2] for w in windows)
        reach = self.df.where((time >= at(low)) & (time < at(high)))
        keys = [named(c) for c in getattr(self.model, "keys", ())]
        cols = {c: named(c) for c in (self.target, *self.features)}
        reach = reach.select(*cols.values(), *[k for k, n in zip(keys, getattr(self.model, "keys", ())) if n not in cols], us(time).alias("_cf_t"))
        return meet(reach, "_cf_t", windows, "_cf_w")

    def counts(self, segment: str, windows) -> dict[int, int]:
        return {r["_cf_w"]: r["count"] for r in self.rows(segment, windows).groupBy("_cf_w").count().collect()}

    def evaluate(self, train: list[tuple[int, int, int]], test: list[tuple[int, int, int]], pairs: list[tuple[int, int]]) -> dict[tuple[int, int], dict[str, float]]:
        """Metrics of each pair (train window, test window)."""
        spark = self.df.sparkSession
        wanted = spark.createDataFrame(pairs, "_cf_m int, _cf_w int")
        tested = self.rows("test", test).join(F.broadcast(wanted), "_cf_w")
        fitted = self.rows("train", train).withColumnRenamed("_cf_w", "_cf_m")
        if isinstance(self.model, NativeModel):
            keys = list(self.model.keys)
            states = fitted.groupBy("_cf_m", *keys).agg(*self.model.state(self.target, self.features))
            if keys:
                tested = tested.join(states, ["_cf_m", *keys], "left").join(fitted.groupBy("_cf_m").agg(self.model.state(self.target, self.features)[0].alias("_cf_all")), "_cf_m")
            else:
                tested = tested.join(states, "_cf_m")
            scored = tested.select(F.col("_cf_m").alias("m"), F.col("_cf_w").alias("w"), named(self.target).alias("y"), self.model.predict(self.features).alias("p"))
        else:
            model, target, features = self.model, self.target, self.features
            both = fitted.withColumn("_cf_w", F.lit(-1)).unionByName(tested.select(*[named(c) for c in fitted.columns], "_cf_w"))

            def run(group: pd.DataFrame) -> pd.DataFrame:
                train = group[group["_cf_w"] < 0].sort_values("_cf_t", kind="stable")
                test = group[group["_cf_w"] >= 0].sort_values("_cf_t", kind="stable")
                own = copy.deepcopy(model)
                own = own.fit(train[features], train[target]) or own
                return pd.DataFrame({"m": test["_cf_m"], "w": test["_cf_w"], "y": test[target].astype(float), "p": own.predict(test[features]) if len(test) else []}).astype({"p": float})

            scored = both.groupBy("_cf_m").applyInPandas(run, "m int, w int, y double, p double")
        from chronofold.operators.runner import FoldRuns

        holder = FoldRuns.__new__(FoldRuns)
        holder.profile = self.profile
        found = holder.metrics(scored.withColumnRenamed("w", "k"))
        return {(m, w): v for (w, m), v in found.items()}


class TrainGrowthPolicy:
    """A fixed test window and train windows of growing size that end where it may start."""

    def __init__(self, time_col, *, cutoff, train_sizes: Sequence, test_size, gap_before_test=None, metric_directions=None):
        self.semantics = TemporalSemanticsSpec.of(time_col)
        self.cutoff, self.directions = instant_us(cutoff), metric_directions
        self.sizes = [SizeSpec.from_value(s) for s in train_sizes]
        if not self.sizes or any(s.kind != "duration" or s.value <= 0 for s in self.sizes):
            raise ValueError("train sizes are positive durations")
        self.test, self.gap = duration_us(test_size), 0 if gap_before_test is None else duration_us(gap_before_test)
        if self.test <= 0:
            raise ValueError("the test size must be positive")

    def evaluate(self, X, *, model, target_col, feature_cols=None, metrics=None) -> TrainGrowthResult:
        """A record for each train size that has rows; its number is its place in the list."""
        df = coerce_tabular_input(X)
        run = _Windows(df, self.semantics, model, target_col, feature_cols, metrics, self.directions)
        start = self.cutoff + self.gap
        test = [(0, start, start + self.test)]
        n = run.counts("test", test).get(0, 0)
        if not n:
            raise ValueError("the test window has no rows")
        train = [(i, self.cutoff - s.value, self.cutoff) for i, s in enumerate(self.sizes)]
        rows = run.counts("train", train)
        train = [w for w in train if rows.get(w[0])]
        if not train:
            raise ValueError("no train window has rows")
        found = run.evaluate(train, test, [(w[0], 0) for w in train])
        records = [{"variant": i, "train_size": str(self.sizes[i]), "train_start": instant(a), "train_end": instant(b), "test_start": instant(start), "test_end": instant(start + self.test), "train_rows": rows[i], "test_rows": n} | found[(i, 0)] for i, a, b in train]
        return TrainGrowthResult(pd.DataFrame(records), run.profile.directions, df.sparkSession)

    def find_optimal_train_size(self, X, *, model, target_col, feature_cols=None, metrics=None, metric: str = "rmse", tolerance: float = 0.0, relative: bool = True) -> dict[str, object]:
        return self.evaluate(X, model=model, target_col=target_col, feature_cols=feature_cols, metrics=metrics).find_optimal_train_size(metric=metric, tolerance=tolerance, relative=relative)


class PerformanceDecayPolicy:
    """A state fitted once and test windows that move away from it, up to the first without rows."""

    def __init__(self, time_col, *, cutoff, train_size, test_size, step, gap_before_test=None, max_windows: int | None = None, metric_directions=None):
        self.semantics = TemporalSemanticsSpec.of(time_col)
        self.cutoff, self.directions = instant_us(cutoff), metric_directions
        self.train = SizeSpec.from_value(train_size)
        self.test, self.step = duration_us(test_size), duration_us(step)
        self.gap = 0 if gap_before_test is None else duration_us(gap_before_test)
        if self.train.kind != "duration" or min(self.train.value, self.test, self.step) <= 0:
            raise ValueError("sizes and step are positive durations")
        if max_windows is not None and max_windows <= 0:
            raise ValueError("max_windows must be positive")
        self.most = max_windows

    def evaluate(self, X, *, model, target_col, feature_cols=None, metrics=None) -> PerformanceDecayResult:
        df = coerce_tabular_input(X)
        run = _Windows(df, self.semantics, model, target_col, feature_cols, metrics, self.directions)
        high = df.select(us(run.time("test")).alias("t")).agg(F.max("t")).first()[0]
        first = self.cutoff + self.gap
        many = 0 if high is None or high < first else (high - first) // self.step + 1
        many = min(many, self.most or many)
        test = [(i, first + i * self.step, first + i * self.step + self.test) for i in range(many)]
        train = [(0, self.cutoff - self.train.value, self.cutoff)]
        n = run.counts("test", test) if test else {}
        kept = []
        for w in test:
            if not n.get(w[0]):
                break
            kept.append(w)
        rows = run.counts("train", train).get(0, 0)
        if not rows or not kept:
            raise ValueError("the train window or the first test window has no rows")
        found = run.evaluate(train, kept, [(0, w[0]) for w in kept])
        records = [{"window": i, "train_size": str(self.train), "train_start": instant(train[0][1]), "train_end": instant(train[0][2]), "test_start": instant(a), "test_end": instant(b), "train_rows": rows, "test_rows": n[i]} | found[(0, i)] for i, a, b in kept]
        return PerformanceDecayResult(pd.DataFrame(records), run.profile.directions, df.sparkSession)

    def find_drift_onset(self, X, *, model, target_col, feature_cols=None, metrics=None, metric: str = "rmse", threshold: float = 0.1, baseline="first", relative: bool = True):
        return self.evaluate(X, model=model, target_col=target_col, feature_cols=feature_cols, metrics=metrics).find_drift_onset(metric=metric, threshold=threshold, baseline=baseline, relative=relative)


class TrainHistoryPolicy(TrainGrowthPolicy):
    """Train growth under the name of the question it answers."""


class DriftMonitoringPolicy(PerformanceDecayPolicy):
    """Performance decay under the name of the question it answers."""


@dataclass
class RollingTrainHistoryResult(_Records):
    metric: str = "rmse"

    def summary(self) -> dict[str, object]:
        sizes = [pd.Timedelta(s) for s in self.records["optimal_train_size"]]
        days = [s / pd.Timedelta("1D") for s in sizes]
        return {"total_folds": len(sizes), "metric": self.metric, "mean_days": mean(days), "median_days": median(days), "min_days": min(days), "max_days": max(days)}


class RollingTrainHistoryPolicy:
    """For each fold of an outer policy, the best of several train sizes: all folds and sizes in one job."""

    def __init__(self, time_col, *, partition, step=None, train_sizes: Sequence, strategy: str = "rolling", allow_partial: bool = False, engine: str = "auto", start_at=None, end_at=None, max_folds: int | None = None, metric_directions=None):
        self.outer = WalkForwardPolicy(time_col=time_col, partition=partition, step=step, strategy=strategy, allow_partial=allow_partial, engine=engine, start_at=start_at, end_at=end_at, max_folds=max_folds)
        self.sizes, self.directions = [SizeSpec.from_value(s) for s in train_sizes], metric_directions

    def plan(self, X, title: str | None = None):
        return self.outer.plan(X, title)

    def evaluate(self, X, *, model, target_col, feature_cols=None, metrics=None, metric: str = "rmse", tolerance: float = 0.0, relative: bool = True) -> RollingTrainHistoryResult:
        """The train windows end where the fold's train ends; only the timeline column places rows, and start_at and end_at bound the outer folds alone."""
        df = coerce_tabular_input(X)
        plan = self.outer.plan(df)
        run = _Windows(df, TemporalSemanticsSpec(self.outer.time_col), model, target_col, feature_cols, metrics, self.directions)
        many = len(self.sizes)
        test, train = [], []
        for k, f in enumerate(plan.folds):
            a, b = (instant_us(x) for x in (f.boundaries["test"].start, f.boundaries["test"].end))
            test.append((k, a, b))
            end = instant_us(f.boundaries["train"].end)
            train += [(k * many + i, end - s.value, end) for i, s in enumerate(self.sizes)]
        rows, n = run.counts("train", train), run.counts("test", test)
        used = [w for w in train if rows.get(w[0])]
        found = run.evaluate(used, test, [(w[0], w[0] // many) for w in used])
        records = []
        for k, f in enumerate(plan.folds):
            own = pd.DataFrame([{"variant": i % many, "train_rows": rows[i], "train_start": a} | found[(i, k)] for i, a, _ in used if i // many == k])
            best = TrainGrowthResult(own, run.profile.directions).find_optimal_train_size(metric=metric, tolerance=tolerance, relative=relative)
            size = self.sizes[int(best["variant"])]
            records.append({"iteration": f.iteration, "fold": f.iteration, "outer_train_start": f.boundaries["train"].start, "outer_train_end": f.boundaries["train"].end, "outer_test_start": f.boundaries["test"].start, "outer_test_end": f.boundaries["test"].end, "optimal_train_size": str(size), "optimal_train_start": instant(int(best["train_start"])), "optimal_train_end": f.boundaries["train"].end, "optimal_train_rows": int(best["train_rows"]), "test_rows": n[k], metric: best[metric]})
        return RollingTrainHistoryResult(pd.DataFrame(records), run.profile.directions, df.sparkSession, metric)
