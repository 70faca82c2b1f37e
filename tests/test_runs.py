import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import chronofold as cf
from chronofold.operators.runner import worsened

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import test modules


class Line:
    def fit(self, X, y):
        a = np.column_stack([X.to_numpy(float), np.ones(len(X))])
        self.w = np.linalg.lstsq(a, y.to_numpy(float), rcond=None)[0]
        return self

    def predict(self, X):
        return np.column_stack([X.to_numpy(float), np.ones(len(X))]) @ self.w


class RunningMean:
    def __init__(self):
        self.n, self.total = 0, 0.0

    def partial_fit(self, X, y):
        self.n, self.total = self.n + len(y), self.total + float(y.sum())
        return self

    def predict(self, X):
        return np.full(len(X), self.total / self.n)


class Mean:
    def fit(self, X, y):
        self.m = float(y.mean())
        return self

    def predict(self, X):
        return np.full(len(X), self.m)


def mae(y, p):
    return float(np.mean(np.abs(y - p)))


def walk(**k):
    return cf.WalkForwardPolicy(time_col="timestamp", partition=cf.TemporalPartitionSpec(train_size=k.pop("train", "3D"), test_size="1D"), step="1D", **k)


def runner(model, **k):
    return cf.WalkForwardRunner(model=model, target_col="target", feature_cols=["feature"], key_col="row_id", **{"metrics": ["mae"]} | k)


def test_native_and_python_models_agree(daily):
    for schedule in ({}, {"retrain": "never"}, {"retrain_interval": 2}):
        a = runner(cf.MeanModel(), **schedule).run(walk(), daily(9))
        b = runner(Mean(), metrics={"mae": mae}, **schedule).run(walk(), daily(9))
        assert np.allclose(a.records["mae"], b.records["mae"]) and list(a.records["retrained"]) == list(b.records["retrained"])
        assert a.predictions_frame().count() == len(a.records)
    assert np.allclose(runner(cf.LinearModel()).run(walk(), daily(9)).records["mae"], 0, atol=1e-9)
    assert np.allclose(runner(Line(), metrics={"mae": mae}).run(walk(), daily(9)).records["mae"], 0, atol=1e-9)


def test_schedules(daily):
    seen = []
    rule = cf.FunctionRetrainPolicy(lambda c: bool(seen.append(c.fold)) or c.fold == 2)
    assert list(runner(cf.MeanModel(), retrain_policy=rule).run(walk(), daily(7)).records["retrained"]) == [True, False, True]
    assert seen == [1, 2]
    assert list(runner(cf.MeanModel(), retrain_interval=2).run(walk(), daily(7)).records["retrained"]) == [True, False, True]
    drift = cf.DriftBasedRetrain("mae", 0.4)
    a = runner(cf.MeanModel(), retrain_policy=drift).run(walk(), daily(9)).records
    b = runner(Mean(), retrain_policy=drift, metrics={"mae": mae}).run(walk(), daily(9)).records
    assert list(a["retrained"]) == list(b["retrained"]) and np.allclose(a["mae"], b["mae"])


def test_drift_rules():
    assert worsened(-0.3, 0.0, 0.1, True, True) and not worsened(1.04, 1.0, 0.05, False, True) and worsened(1.06, 1.0, 0.05, False, True)
    h = pd.DataFrame({"fold": [0, 1], "retrained": [True, False], "rmse": [1.0, 1.2]})
    c = cf.RetrainContext(2, None, h, {}, 0, "rmse")
    assert cf.DriftBasedRetrain(threshold=0.1).should_retrain(c) and not cf.DriftBasedRetrain(threshold=0.1, baseline="previous_fold").should_retrain(c)
    with pytest.raises(ValueError):
        cf.DriftBasedRetrain("absent").should_retrain(c)
    with pytest.raises(ValueError):
        cf.DriftBasedRetrain(baseline="other")


def test_results(daily):
    r = runner(cf.MeanModel(), metrics=["mae", "rmse"]).run(walk(), daily(8))
    assert r.metric_trajectory().count() == 2 * len(r.records) and r.summary()["metrics"]["mae"]["best"] == pytest.approx(2)
    assert r.retrain_events().count() == len(r.records) and "folds" in r.to_dict()
    with pytest.raises(ValueError):
        cf.EvaluationProfile({}).resolve()
    with pytest.raises(ValueError):
        cf.EvaluationProfile(["mae"], {"mae": "up"}).resolve()
    assert cf.ClassificationProfile().resolve().directions == {"accuracy": "max"}


def test_system(daily):
    class System:
        def update(self, train):
            return cf.SystemUpdateResult(train.agg({"target": "avg"}).first()[0], {"rows": train.count()})

        def evaluate(self, state, test):
            return {"error": abs(test.agg({"target": "avg"}).first()[0] - state)}

    r = cf.TemporalSystemRunner(system=System(), update_interval=2).run(walk(), daily(7))
    assert list(r.records["updated"]) == [True, False, True] and list(r.records["error"]) == [2, 3, 2]
    assert r.evaluation_details().count() == 3 and r.update_events().count() == 2 and r.summary()["retrains"] == 2

    class Empty(System):
        def evaluate(self, state, test):
            return {}

    with pytest.raises(ValueError):
        cf.TemporalSystemRunner(system=Empty()).run(walk(), daily(7))


def test_growth_decay_and_history(daily):
    growth = cf.TrainHistoryPolicy("timestamp", cutoff="2024-01-20", train_sizes=["5D", "10D", "15D"], test_size="3D")
    r = growth.evaluate(daily(40), model=cf.MeanModel(), target_col="target", feature_cols=["feature"], metrics=["rmse"])
    assert list(r.records["train_rows"]) == [5, 10, 15] and r.records["train_size"][0] == "5 days 00:00:00"
    assert r.find_optimal_train_size(metric="rmse")["variant"] == 0
    python = growth.evaluate(daily(40), model=Mean(), target_col="target", feature_cols=["feature"], metrics={"rmse": lambda y, p: float(np.sqrt(np.mean((y - p) ** 2)))})
    assert np.allclose(python.records["rmse"], r.records["rmse"])
    decay = cf.DriftMonitoringPolicy("timestamp", cutoff="2024-01-10", train_size="5D", test_size="2D", step="2D", max_windows=4)
    shifted = daily(40, target="IF(row_id >= 13, 150, 100)")
    d = decay.evaluate(shifted, model=cf.MeanModel(), target_col="target", feature_cols=["feature"], metrics=["mae"])
    assert d.find_drift_onset(metric="mae", threshold=1)["window"] == 2 and d.find_drift_onset(metric="mae", threshold=99) is None
    h = cf.RollingTrainHistoryPolicy("timestamp", partition=cf.TemporalPartitionSpec(train_size="10D", test_size="2D"), step="5D", train_sizes=["3D", "8D"])
    r = h.evaluate(daily(30), model=cf.MeanModel(), target_col="target", feature_cols=["feature"], metrics=["rmse"])
    assert set(r.records["optimal_train_rows"]) == {3} and r.summary()["mean_days"] == 3
    best = cf.TrainGrowthResult(pd.DataFrame({"variant": [0, 1, 2], "train_rows": [10, 20, 30], "accuracy": [0.8, 0.9, 0.86]}), {"accuracy": "max"})
    assert best.find_optimal_train_size(metric="accuracy", tolerance=0.05)["variant"] == 1
    with pytest.raises(ValueError):
        cf.PerformanceDecayResult(pd.DataFrame({"window": [0], "rmse": [1.0]}), {}).find_drift_onset(metric="absent")


def test_bands(daily):
    band = lambda c: {"lower": c.predictions - 2, "upper": c.predictions + 2, "note": "x"}
    r = cf.estimate_prediction_band_by_fold(walk(), daily(8), model=Mean(), target_col="target", feature_cols=["feature"], band_estimator=band, key_col="row_id")
    row = r.to_frame().orderBy("fold").first()
    assert (row["prediction_band_width_mean"], row["prediction_band_coverage"]) == (4.0, 1.0)
    assert r.artifacts_frame().count() == r.to_frame().count() and r.band_summary().first()["mean_coverage"] == 1
    bad = lambda c: {"lower": c.predictions + 1, "upper": c.predictions}
    with pytest.raises(Exception, match="lower is above upper"):
        cf.estimate_prediction_band_by_fold(walk(), daily(8), model=Mean(), target_col="target", feature_cols=["feature"], band_estimator=bad, key_col="row_id").to_frame().collect()


def online(initial, update, model=None, **k):
    return cf.OnlineTemporalRunner("timestamp", "target", model or cf.MeanModel(), initial, update, ["feature"], metrics=["mae"], keys=["row_id"], **k)


def test_online(spark, daily):
    for model in (cf.MeanModel(), RunningMean()):
        r = online(4, 1, model).run(daily(8))
        assert list(r.records["mae"]) == [2.5, 3, 3.5, 4] and sorted(x["prediction"] for x in r.predictions.collect()) == [101.5, 102, 102.5, 103]
    assert list(online("4D", "2D").run(daily(10)).records["batch_rows"]) == [2, 2, 2]
    assert list(online(0.5, 0.2).run(daily(10)).records["batch_rows"]) == [2, 2, 1]
    sparse = daily(5).where("row_id in (0, 1, 4)")
    assert [b.day for b in online("1D", "1D").run(sparse).records["batch_start"]] == [2, 5]
    r = online(4, 1, Mean(), update_strategy=cf.RefitUpdateStrategy(3)).run(daily(8))
    assert sorted(x["prediction"] for x in r.predictions.collect()) == [102, 103, 104, 105]
    with pytest.raises(ValueError):
        online("0D", "1D").run(daily(8))
    with pytest.raises(TypeError):
        online(4, 1, retrain_trigger=lambda h, x: 3).run(daily(8))
    r = online(4, 1, retrain_trigger=lambda h, x: {"reason": "r", "level": len(h)} if x["mae"] > 3 else None).run(daily(8))
    assert list(r.records["retrain_checkpoint"]) == [False, False, True, True] and r.retrain_checkpoints().count() == 2


def test_online_study(daily):
    study = cf.OnlineUpdatePolicyStudy("timestamp", "target", cf.MeanModel(), 4, [cf.OnlineUpdatePolicy("often", 1), cf.OnlineUpdatePolicy("seldom", 2, update_cost=1.5)], ["feature"], metrics=["mae"], keys=["row_id"])
    r = study.run(daily(8))
    assert list(r.records["updates"]) == [4, 2] and list(r.records["total_update_cost"]) == [4, 3]
    assert r.find_optimal_policy()["policy"] == "often" and r.find_optimal_policy(update_cost_weight=10)["policy"] == "seldom"
    assert r.metric_trajectory().count() == 6


NAMES = ["position", "fold", "segment", "m", "k", "w", "batch", "y", "p", "row_id2"]


@pytest.fixture
def odd_names(daily):
    return daily(12).selectExpr("*", *(f"feature AS {n}" for n in NAMES))


def test_features_may_have_any_name(odd_names):
    for model in (cf.MeanModel(), Mean()):
        for size in ("4D", 4):
            policy = cf.WalkForwardPolicy(time_col="timestamp", partition=cf.TemporalPartitionSpec(train_size=size, test_size="2D" if size == "4D" else 2), step="2D" if size == "4D" else 2, keys=["row_id"])
            r = cf.WalkForwardRunner(model=model, target_col="target", feature_cols=NAMES, metrics=["mae"], key_col="row_id").run(policy, odd_names)
            assert set(r.records["mae"]) == {3.0} and r.predictions.count() == 2 * len(r.records)
        r = cf.OnlineTemporalRunner("timestamp", "target", model, 4, 2, NAMES, metrics=["mae"], keys=["row_id"]).run(odd_names)
        assert list(r.records["batch_rows"]) == [2] * 4
        study = cf.TrainHistoryPolicy("timestamp", cutoff="2024-01-08", train_sizes=["2D", "4D"], test_size="2D")
        assert list(study.evaluate(odd_names, model=model, target_col="target", feature_cols=NAMES, metrics=["mae"]).records["train_rows"]) == [2, 4]
    from chronofold.operators.runner import features_of

    assert set(NAMES) <= set(features_of(odd_names, "target", None, cf.TemporalSemanticsSpec("timestamp"))[1])


def test_positional_slices_keep_a_column_called_position(odd_names):
    policy = cf.WalkForwardPolicy(time_col="timestamp", partition=cf.TemporalPartitionSpec(train_size=4, test_size=2), step=2, keys=["row_id"])
    split = next(iter(policy.plan(odd_names).iter_splits()))
    assert split.segment("test").columns == odd_names.columns and sorted(r["position"] for r in split.segment("test").collect()) == [4, 5]


def test_retrain_arguments():
    from chronofold.operators.runner import policy_of

    assert type(policy_of(False, 2, None)) is type(policy_of("never", 3, None)) is cf.NeverRetrain
    assert type(policy_of("always", 2, None)) is type(policy_of(True, 1, None)) is cf.AlwaysRetrain
    assert policy_of(True, 3, None).every == policy_of("periodic", 3, None).every == 3
    for bad in (("periodic", None, None), ("weekly", None, None), (True, 2, cf.NeverRetrain())):
        with pytest.raises(ValueError):
            policy_of(*bad)


def test_zero_baseline():
    assert not worsened(0.0, 0.0, 0.0, False, True) and not worsened(0.1, 0.0, 0.1, False, True) and worsened(0.11, 0.0, 0.1, False, True)
    assert worsened(0.1, 0.0, 0.1, False, False) and not worsened(-0.1, 0.0, 0.1, True, True)


def test_drift_falls_back_to_the_first_row():
    import pandas as pd

    history = pd.DataFrame({"fold": [3, 4], "retrained": [True, False], "mae": [1.0, 1.5]})
    for last in (None, 9):
        assert cf.DriftBasedRetrain("mae", 0.4).should_retrain(cf.RetrainContext(5, None, history, {}, last))


def test_trigger_signals(daily):
    seen = []

    def trigger(history, latest):
        seen.append((len(history), history["mae"].iloc[-1] == latest["mae"]))
        return [{"retrain": False, "reason": "calm"}, {"retrain": True, "checkpoint": False, "level": 2}, {"checkpoint": False}, True][latest["batch"]]

    r = online(4, 1, retrain_trigger=trigger).run(daily(8)).records
    assert list(r["retrain_checkpoint"]) == [False, True, False, True] and seen == [(i, True) for i in (1, 2, 3, 4)]
    assert r["retrain_reason"].iloc[0] == "calm" and r["retrain_level"].iloc[1] == 2


def test_a_trigger_sees_every_record_and_signal_in_time_in_proportion(daily):
    import time

    seen = []

    def trigger(history, latest):
        seen.append(history.iloc[-2:].to_dict("records"))
        return [{"level": 1}, {"level": "high", "reason": "r"}, None, {"level": 3}][latest["batch"]]

    online(4, 1, retrain_trigger=trigger).run(daily(8))
    assert [x[-1]["mae"] for x in seen] == [2.5, 3, 3.5, 4] and "retrain_level" not in seen[0][0] and seen[1][0]["retrain_level"] == 1
    assert seen[2][0] | {"retrain_level": "high", "retrain_checkpoint": True, "retrain_reason": "r", "mae": 3.0} == seen[2][0]
    assert seen[3][0]["retrain_checkpoint"] is False and seen[3][1]["retrain_checkpoint"] != seen[3][1]["retrain_checkpoint"]
    began = time.time()
    many = online(1, 1, retrain_trigger=lambda h, x: len(h) == x["batch"] + 1).run(daily(20_001).withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, row_id)")))
    assert many.records["retrain_checkpoint"].sum() == 20_000 and time.time() - began < 60


def test_spans_and_cells_of_any_size_agree(daily, monkeypatch):
    from chronofold.functions import timeline
    from chronofold.operators import online as module

    odd = daily(40).selectExpr("row_id", "CASE WHEN row_id % 3 = 0 THEN null WHEN row_id < 20 THEN timestamp ELSE timestamp_ntz'2024-05-05' + make_interval(0, 0, 0, 0, 0, 0, row_id % 4) END AS timestamp", "feature", "target")
    rows = sorted((r["timestamp"] is None, r["timestamp"], r["row_id"]) if r["timestamp"] else (True, None, r["row_id"]) for r in odd.collect())
    want = [i for _, _, i in rows]
    for cells, most in ((16, 1_000_000), (2, 1), (1, 3)):
        monkeypatch.setattr(timeline, "LEAST_CELLS", cells)
        monkeypatch.setattr(timeline, "RANGE_ROWS", most)
        found = timeline.with_position(odd, timeline.as_time(odd, "timestamp"), ["row_id"]).collect()
        assert [r["row_id"] for r in sorted(found, key=lambda r: r[timeline.POSITION])] == want and sorted(r[timeline.POSITION] for r in found) == list(range(40))
    monkeypatch.setattr(module, "SPAN", 2)
    assert list(online(4, 1).run(daily(8)).records["mae"]) == [2.5, 3, 3.5, 4]
    assert [b.day for b in online("1D", "1D").run(daily(9).where("row_id in (0, 1, 4, 7)")).records["batch_start"]] == [2, 5, 8]


def test_without_keys_ties_follow_all_columns(daily):
    from chronofold.functions import timeline

    tied = daily(9).selectExpr("timestamp_ntz'2024-01-01' AS timestamp", "8 - feature AS feature", "map('a', row_id) AS other")
    for _ in range(2):
        found = timeline.with_position(tied.repartition(3), timeline.as_time(tied, "timestamp"), []).collect()
        assert [r["feature"] for r in sorted(found, key=lambda r: r[timeline.POSITION])] == list(range(9))


def test_losses_of_blocks_of_folds(daily, monkeypatch):
    from chronofold.operators import runner as module

    runs = []
    for size in (48, 1, 3):
        monkeypatch.setattr(module, "LOSSES", size)
        r = cf.WalkForwardRunner(model=cf.MeanModel(), target_col="target", feature_cols=["feature"], metrics=["mae"], retrain_policy=cf.FunctionRetrainPolicy(lambda c: c.fold in (2, 3, 6)), key_col="row_id")
        policy = cf.WalkForwardPolicy(time_col="timestamp", partition=cf.TemporalPartitionSpec(train_size="3D", test_size="1D"), step="1D")
        runs.append(r.run(policy, daily(13)).records[["fold", "retrained", "mae"]].values.tolist())
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) >= 9
