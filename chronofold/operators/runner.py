"""Models walked forward over folds: schedules of fitting, native states, Python estimators, results."""

from __future__ import annotations

import copy
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.metrics import EvaluationProfile, NativeModel, ResolvedEvaluationProfile
from chronofold.functions.timeline import POSITION, named, resolve, table
from chronofold.operators.reporting import json_ready
from chronofold.operators.splitting import TemporalBacktestSplitter, TemporalSimulation, membership
from chronofold.plans.plan import PartitionPlan
from chronofold.sources.adapters import coerce_tabular_input


@dataclass(frozen=True)
class RetrainContext:
    """What a rule sees: the fold, and the records of the folds before it."""

    fold: int
    split: object
    history: pd.DataFrame
    metric_directions: Mapping[str, str]
    last_retrain_fold: int | None
    primary_metric: str | None = None


class RetrainPolicy:
    def should_retrain(self, context: RetrainContext) -> bool:
        raise NotImplementedError

    def schedule(self, folds: int) -> list[bool] | None:
        """Which folds fit, if that doesn't depend on results; the first always does."""
        return None


class AlwaysRetrain(RetrainPolicy):
    def should_retrain(self, context):
        return True

    def schedule(self, folds):
        return [True] * folds


class NeverRetrain(RetrainPolicy):
    def should_retrain(self, context):
        return False

    def schedule(self, folds):
        return [k == 0 for k in range(folds)]


class PeriodicRetrain(RetrainPolicy):
    def __init__(self, every: int):
        if every <= 0:
            raise ValueError("every must be positive")
        self.every = every

    def should_retrain(self, context):
        return context.fold % self.every == 0

    def schedule(self, folds):
        return [k % self.every == 0 for k in range(folds)]


class FunctionRetrainPolicy(RetrainPolicy):
    def __init__(self, rule: Callable[[RetrainContext], bool]):
        if not callable(rule):
            raise TypeError("a rule is a function of a RetrainContext")
        self.rule = rule

    def should_retrain(self, context):
        return bool(self.rule(context))


class DriftBasedRetrain(RetrainPolicy):
    """Fit again once the latest metric is worse than a baseline by more than a threshold.

    The baseline `previous_fold` is the latest record itself, so it fires only for a threshold of 0.
    """

    BASELINES = ("last_retrain", "first", "best", "previous_fold")

    def __init__(self, metric: str | None = None, threshold: float = 0.05, baseline: str = "last_retrain", relative: bool = True):
        if baseline not in self.BASELINES:
            raise ValueError(f"baseline must be one of {', '.join(self.BASELINES)}")
        if threshold < 0:
            raise ValueError("threshold must not be negative")
        self.metric, self.threshold, self.baseline, self.relative = metric, threshold, baseline, relative

    def should_retrain(self, context):
        h = context.history
        metric = self.metric or context.primary_metric
        if metric is None or len(h) and metric not in h:
            raise ValueError(f"no metric {metric!r} in the history")
        if not len(h):
            return True
        largest = context.metric_directions.get(metric, "min") == "max"
        latest = float(h[metric].iloc[-1])
        if self.baseline == "first":
            base = float(h[metric].iloc[0])
        elif self.baseline == "previous_fold":
            base = latest
        elif self.baseline == "best":
            base = float(h[metric].max() if largest else h[metric].min())
        else:
            rows = h[h["fold"] == context.last_retrain_fold]
            base = float((rows if len(rows) else h)[metric].iloc[0])
        return worsened(latest, base, self.threshold, largest, self.relative)


def worsened(latest: float, base: float, threshold: float, largest: bool, relative: bool) -> bool:
    """Whether the change for the worse reaches the threshold. Next to a baseline of 0 no ratio exists: there the value itself has to pass the threshold."""
    change = base - latest if largest else latest - base
    if not relative:
        return change >= threshold
    return change / abs(base) >= threshold if base else change > threshold


def policy_of(retrain, interval: int | None, policy: RetrainPolicy | None) -> RetrainPolicy:
    """The policy that a runner's arguments name. An interval says how often True or 'periodic' fits; it means nothing to the others."""
    if policy is not None:
        if interval is not None:
            raise ValueError("a policy has its own rhythm: give it or an interval")
        return policy
    name = {True: "always" if interval in (None, 1) else "periodic", False: "never"}[retrain] if isinstance(retrain, bool) else retrain
    if name == "periodic" and interval is None:
        raise ValueError("a periodic policy needs retrain_interval")
    made = {"always": AlwaysRetrain, "never": NeverRetrain, "periodic": lambda: PeriodicRetrain(interval)}
    if name not in made:
        raise ValueError("retrain is True, False, 'always', 'never' or 'periodic'")
    return made[name]()


def resolve_workflow(workflow, X) -> PartitionPlan:
    """The plan of a policy, simulation or splitter, or of anything that has plan(X)."""
    if isinstance(workflow, PartitionPlan):
        return workflow
    if isinstance(workflow, TemporalSimulation | TemporalBacktestSplitter) or hasattr(workflow, "plan"):
        return workflow.plan(X)
    if hasattr(workflow, "as_splitter"):
        return workflow.as_splitter().plan(X)
    raise TypeError("a workflow is a policy, a simulation or a splitter")


def features_of(df: DataFrame, target_col, feature_cols, semantics) -> tuple[str, list[str]]:
    """Names of the target and the features: those given, or all but the target and the time columns."""
    target = resolve(df, target_col)
    if feature_cols is not None:
        features = [resolve(df, c) for c in feature_cols]
    else:
        off = {target, POSITION, *(resolve(df, c) for c in (semantics.timeline_col, semantics.effective_order_col, *semantics.segment_time_cols.values()))}
        features = [c for c in df.columns if c not in off]
    if not features:
        raise ValueError("no feature columns")
    return target, features


@dataclass
class WalkForwardRunResult:
    """records: a row for each fold; predictions: a row for each predicted row, left on the executors."""

    records: pd.DataFrame
    predictions: DataFrame | None
    metric_directions: dict[str, str]
    retrain_policy: str
    primary_metric: str | None = None
    metric_columns: tuple[str, ...] = ()
    spark: object = None

    FLAG = "retrained"

    def to_frame(self) -> DataFrame:
        return table(self.spark, self.records)

    def predictions_frame(self) -> DataFrame | None:
        return self.predictions

    @property
    def metric_names(self) -> list[str]:
        return list(self.metric_columns)

    def fold_summary(self) -> DataFrame:
        return self.to_frame()

    def metric_trajectory(self) -> DataFrame:
        """fold, metric, value, direction, retrained: a row for each metric and fold."""
        long = self.to_frame().unpivot(["fold", self.FLAG], list(self.metric_columns), "metric", "value")
        largest = [m for m in self.metric_columns if self.metric_directions.get(m) == "max"]
        direction = F.when(F.col("metric").isin(largest), "max").otherwise("min") if largest else F.lit("min")
        return long.select("fold", "metric", "value", direction.alias("direction"), self.FLAG)

    def retrain_events(self) -> DataFrame:
        return self.to_frame().where(self.FLAG)

    def summary(self) -> dict[str, object]:
        out: dict[str, object] = {"total_folds": len(self.records), "retrain_policy": self.retrain_policy, "retrains": int(self.records[self.FLAG].sum()), "primary_metric": self.primary_metric, "metrics": {}}
        for m in self.metric_columns:
            v = self.records.set_index("fold")[m].dropna()
            if len(v):
                largest = self.metric_directions.get(m) == "max"
                out["metrics"][m] = {"mean": float(v.mean()), "best": float(v.max() if largest else v.min()), "best_fold": int(v.idxmax() if largest else v.idxmin()), "direction": self.metric_directions.get(m, "min")}
        return out

    def report_data(self, *, include_predictions: bool = False) -> dict[str, object]:
        out = {"summary": self.summary(), "folds": self.records.to_dict("records")}
        if include_predictions and self.predictions is not None:
            out["predictions"] = [r.asDict() for r in self.predictions.collect()]
        return json_ready(out)

    def to_dict(self, *, include_predictions: bool = False) -> dict[str, object]:
        return self.report_data(include_predictions=include_predictions)


class WalkForwardRunner:
    """Fits and evaluates a model fold by fold under a policy of fitting again.

    A NativeModel runs as aggregates and joins alone. Any object with fit(X, y) and predict(X) runs in Python workers: one group for each fitted
    state if the schedule is known, else fold after fold on the driver's order.
    """

    def __init__(self, *, model, target_col, feature_cols: Sequence | None = None, retrain: bool | str = True, retrain_interval: int | None = None, retrain_policy: RetrainPolicy | None = None, metrics=None, metric_directions: Mapping[str, str] | None = None, primary_metric: str | None = None, evaluation: EvaluationProfile | None = None, include_predictions: bool = True, prediction_column: str = "prediction", key_col: str | None = None):
        self.model, self.target_col, self.feature_cols = model, target_col, feature_cols
        self.policy = policy_of(retrain, retrain_interval, retrain_policy)
        if evaluation is not None and metrics is not None:
            raise ValueError("give metrics or an evaluation profile")
        self.profile = (evaluation or EvaluationProfile(metrics, metric_directions, primary_metric)).resolve()
        self.include_predictions, self.prediction_column, self.key_col = include_predictions, prediction_column, key_col

    def run(self, workflow, X, y: DataFrame | None = None) -> WalkForwardRunResult:
        df = coerce_tabular_input(X)
        if y is not None:
            if self.key_col is None:
                raise ValueError("a separate target is joined by key_col")
            target = [c for c in y.columns if c != self.key_col]
            if len(target) != 1:
                raise ValueError("a separate target has a key and one other column")
            both = df.join(y.select(named(self.key_col), named(target[0]).alias("__target__")), self.key_col)
            if len({t.select(named(self.key_col)).count() for t in (df, y, both)}) != 1:
                raise ValueError("a separate target has one row for each key of the table")
            df = both
        plan = resolve_workflow(workflow, df)
        if not plan.folds:
            raise ValueError("the plan has no folds")
        runner = FoldRuns(plan, self.model, "__target__" if y is not None else self.target_col, self.feature_cols, self.profile, self.key_col)
        schedule = self.policy.schedule(len(plan.folds))
        if schedule is None:
            schedule, metrics = runner.replay(self.policy)
        else:
            metrics = None
        fitted, at = [], 0
        for k, again in enumerate(schedule):
            at = k if again else at
            fitted.append(at)
        scored = runner.scored([(k, m) for k, m in enumerate(fitted)])
        if metrics is None:
            metrics = runner.metrics(scored)
        records = []
        for k, f in enumerate(plan.folds):
            train, test = f.boundaries["train"], f.boundaries["test"]
            records.append({"fold": f.iteration, "retrained": schedule[k], "last_retrain_fold": plan.folds[fitted[k]].iteration, "train_rows": f.counts["train"], "test_rows": f.counts["test"], "train_start": train.start, "train_end": train.end, "test_start": test.start, "test_end": test.end} | metrics[(k, fitted[k])])
        predictions = None
        if self.include_predictions:
            flags = plan.spark.createDataFrame([(k, f.iteration, schedule[k]) for k, f in enumerate(plan.folds)], "k int, fold int, retrained boolean")
            predictions = scored.join(F.broadcast(flags), "k").select("fold", F.col("row_id").alias("row_index"), "retrained", F.col("y").alias("y_true"), F.col("p").alias(self.prediction_column))
        return WalkForwardRunResult(pd.DataFrame(records), predictions, dict(self.profile.directions), type(self.policy).__name__, self.profile.primary_metric, tuple(self.profile.metrics), plan.spark)


#: Folds whose losses one job gives where decisions depend on them: some LOSSES * LOSSES / 2 pairs of a fold and a state.
LOSSES = 48


@dataclass
class FoldRuns:
    """Predictions of the test rows of folds by states fitted on the train rows of (other) folds."""

    plan: PartitionPlan
    model: object
    target_col: object
    feature_cols: Sequence | None
    profile: ResolvedEvaluationProfile
    key_col: str | None = None
    cache: dict = field(default_factory=dict)

    def __post_init__(self):
        split = self.plan.split_of(self.plan.folds[0])
        self.target, self.features = features_of(split.frame, self.target_col, self.feature_cols, split.semantics)
        keys = list(getattr(self.model, "keys", ()))
        # Without a key a row is known by its place in the scan, given before it goes to several folds.
        frame = split.frame.withColumn("_cf_row", named(self.key_col) if self.key_col else F.monotonically_increasing_id())
        names = list(dict.fromkeys([self.target, *self.features, *keys, "_cf_row"]))
        of = {f.iteration: k for k, f in enumerate(self.plan.folds)}
        rows = membership(self.plan, names, "_cf_fold", "_cf_segment", frame)
        if of != {k: k for k in of}:
            index = self.plan.spark.createDataFrame(list(of.items()), "_cf_fold int, _cf_k int")
            rows = rows.join(F.broadcast(index), "_cf_fold")
        else:
            rows = rows.withColumn("_cf_k", F.col("_cf_fold"))
        self.rows = rows

    def _pairs(self, pairs) -> DataFrame:
        return self.plan.spark.createDataFrame(list(pairs), "_cf_k int, _cf_m int")  # a row for each fold, or each pair of folds

    def states(self) -> DataFrame:
        train = self.rows.where("_cf_segment = 'train'")
        keys = [named(c) for c in self.model.keys]
        return train.groupBy(F.col("_cf_k").alias("_cf_m"), *keys).agg(*self.model.state(self.target, self.features))

    def scored(self, pairs) -> DataFrame:
        """k, m, row_id, y, p of each test row of fold k under the state of fold m."""
        test = self.rows.where("_cf_segment = 'test'").join(F.broadcast(self._pairs(pairs)), "_cf_k")
        if isinstance(self.model, NativeModel):
            wanted = sorted({m for _, m in pairs})
            states = self.states().where(F.col("_cf_m").isin(wanted))
            if self.model.keys:
                overall = self.rows.where("_cf_segment = 'train'").groupBy(F.col("_cf_k").alias("_cf_m")).agg(self.model.state(self.target, self.features)[0].alias("_cf_all"))
                out = test.join(states, ["_cf_m", *self.model.keys], "left").join(overall, "_cf_m")
            else:
                out = test.join(states, "_cf_m")  # a row for each fitted fold
            return out.select(F.col("_cf_k").alias("k"), F.col("_cf_m").alias("m"), F.col("_cf_row").alias("row_id"), named(self.target).alias("y"), self.model.predict(self.features).alias("p"))
        return self._python(pairs)

    def _python(self, pairs) -> DataFrame:
        """One group for each fitted state: its train rows, and the test rows of every fold that it is used for."""
        pairs = list(pairs)
        wanted = self._pairs(pairs)
        fits = self.plan.spark.createDataFrame([(m,) for m in sorted({m for _, m in pairs})], "_cf_m int")
        train = self.rows.where("_cf_segment = 'train'").join(F.broadcast(fits), F.col("_cf_k") == F.col("_cf_m"))
        both = train.unionByName(self.rows.where("_cf_segment = 'test'").join(F.broadcast(wanted), "_cf_k"))
        model, target, features = self.model, self.target, self.features
        kind = dict(self.rows.dtypes)[target]
        kind = kind if kind == "string" else "double"
        id_kind = dict(self.rows.dtypes)["_cf_row"]

        def fit_and_score(group: pd.DataFrame) -> pd.DataFrame:
            own = copy.deepcopy(model)
            train = group[group["_cf_segment"] == "train"].sort_values("_cf_row")
            test = group[group["_cf_segment"] == "test"].sort_values("_cf_row")
            own = own.fit(train[features], train[target]) or own
            out = pd.DataFrame({"k": test["_cf_k"], "m": test["_cf_m"], "row_id": test["_cf_row"], "y": test[target], "p": own.predict(test[features]) if len(test) else []})
            return out if kind == "string" else out.astype({"y": float, "p": float})

        return both.groupBy("_cf_m").applyInPandas(fit_and_score, f"k int, m int, row_id {id_kind}, y {kind}, p {kind}")

    def metrics(self, scored: DataFrame) -> dict[tuple[int, int], dict[str, float]]:
        """Metrics of each (k, m): aggregates for native metrics; others get the arrays of their group."""
        profile = self.profile
        native = [f(F.col("y"), F.col("p")).alias(n) for n, f in profile.metrics.items() if profile.native[n]]
        python = {n: f for n, f in profile.metrics.items() if not profile.native[n]}
        out: dict[tuple[int, int], dict[str, float]] = {}
        grouped = scored.groupBy("k", "m")
        for r in grouped.agg(F.count(F.lit(1)).alias("_cf_n"), *native).collect():  # a row for each fold
            out[(r["k"], r["m"])] = {n: None if r[n] is None else float(r[n]) for n in profile.metrics if profile.native[n]}
        if python:

            def apply(group: pd.DataFrame) -> pd.DataFrame:
                values = [float(f(group["y"].to_numpy(), group["p"].to_numpy())) for f in python.values()]
                return pd.DataFrame([[int(group["k"].iloc[0]), int(group["m"].iloc[0]), values]], columns=["k", "m", "v"])

            for r in grouped.applyInPandas(apply, "k int, m int, v array<double>").collect():
                out[(r["k"], r["m"])] |= dict(zip(python, r["v"]))
        return {key: {n: row.get(n) for n in profile.metrics} for key, row in out.items()}

    def loss(self, k: int, m: int) -> dict[str, float]:
        """Metrics of fold k under the state of fold m. A job scores a block of folds from k on, under m and under every state that a decision among them may fit."""
        if (k, m) not in self.cache:
            block = range(k, min((k // LOSSES + 1) * LOSSES, len(self.plan.folds)))
            pairs = {(j, s) for j in block for s in (m, *range(k, j + 1)) if s <= j} - self.cache.keys()
            self.cache |= self.metrics(self.scored(sorted(pairs)))
        return self.cache[(k, m)]

    def replay(self, policy: RetrainPolicy) -> tuple[list[bool], dict]:
        """Decide fold after fold; a native model takes its losses from a job for each block of folds, another is fitted when a decision asks for it."""
        native = isinstance(self.model, NativeModel)
        schedule, found, history, last = [], {}, [], None
        for k, f in enumerate(self.plan.folds):
            context = RetrainContext(f.iteration, self.plan.split_of(f), pd.DataFrame(history), self.profile.directions, None if last is None else self.plan.folds[last].iteration, self.profile.primary_metric)
            again = k == 0 or bool(policy.should_retrain(context))
            last = k if again else last
            schedule.append(again)
            loss = self.loss(k, last) if native else self.metrics(self.scored([(k, last)]))[(k, last)]
            found[(k, last)] = loss
            history.append({"fold": f.iteration, "retrained": again, "last_retrain_fold": self.plan.folds[last].iteration, "train_rows": f.counts["train"], "test_rows": f.counts["test"]} | {n: float("nan") if v is None else v for n, v in loss.items()})
        return schedule, found
