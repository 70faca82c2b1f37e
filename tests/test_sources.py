import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from chronofold import tools
from chronofold.sources.adapters import coerce_tabular_input, detect_backend, missing_columns
from chronofold.sources.readers import load_dataset_frame, preview_dataset
from chronofold.streaming.prequential import prequential_mse, sessions, window_sums


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    pdf = pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=40).astype(str), "feature": range(40), "target": range(100, 140)})
    pdf.to_csv(at / "x.csv", index=False)
    pdf.to_parquet(at / "x.parquet")
    with zipfile.ZipFile(at / "x.zip", "w") as z:
        z.write(at / "x.csv", "x.csv")
    with zipfile.ZipFile(at / "none.zip", "w") as z:
        z.writestr("a.txt", "a")
    (at / "empty.csv").write_text("a,b\n")
    return at


def test_readers(spark, files):
    for name in ("x.csv", "x.parquet", "x.zip"):
        df = load_dataset_frame(spark, str(files / name))
        assert df.columns == ["timestamp", "feature", "target"] and df.count() == 40
    assert len(preview_dataset(spark, str(files / "x.csv"), 3)["rows"]) == 3
    for name, error in (("none.zip", Exception), ("empty.csv", ValueError), ("absent.csv", FileNotFoundError), ("x.other", ValueError)):
        with pytest.raises(error):
            load_dataset_frame(spark, str(files / name))


def test_adapters(spark):
    assert detect_backend(np.zeros(3)) == "numpy"
    assert coerce_tabular_input(np.zeros((4, 2))).columns == ["0", "1"] and coerce_tabular_input(np.zeros(3)).count() == 3
    assert coerce_tabular_input(np.array([(1, "a")], dtype=[("num", "i4"), ("txt", "U1")])).columns == ["num", "txt"]
    assert coerce_tabular_input(pd.DataFrame({"a": [1]})).first()["a"] == 1
    assert missing_columns(["a", "z", 3], ["a", "b"]) == ["z", 3]
    for bad in (1, np.zeros((1, 1, 1)), "text"):
        with pytest.raises(TypeError):
            coerce_tabular_input(bad)


def test_tools(spark, files):
    path = str(files / "x.csv")
    found = tools.inspect_local_dataset(spark, path)
    assert found["total_rows"] == 40 and found["time_candidates"][0]["name"] == "timestamp" and found["target_candidates"][0]["name"] == "target"
    policy = {"time_col": "timestamp", "partition": {"train_size": "10D", "test_size": "5D"}, "step": "5D"}
    assert tools.validate_temporal_partition_policy(spark, path, **policy)["total_folds"] == 5
    assert len(tools.plan_walk_forward_simulation(spark, path, preview=2, **policy)["folds"]) == 2
    assert tools.run_walk_forward_simulation(spark, path, **policy)["total_folds"] == 5
    assert tools.run_simulation_campaign(spark, path, {"a": policy})[0]["total_folds"] == 5
    assert tools.run_walk_forward_baseline_model(spark, path, "target", **policy)["summary"]["total_folds"] == 5
    assert tools.compare_retrain_policy_baselines(spark, path, "target", **policy)["never"]["retrains"] == 1
    assert found["sampled"] and found["target_candidates"][0]["score"] == 1.45 and not found["warnings"]
    suggested = tools.suggest_temporal_partition_policy(spark, path)["suggestion"]
    assert suggested["partition"] == {"layout": "train_test", "train_size": "23D", "test_size": "1D"} and suggested["max_folds"] == 20
    weekly = tools.suggest_temporal_partition_policy(spark, path, "timestamp", "weekly_retraining")["suggestion"]
    assert weekly["step"] == weekly["partition"]["test_size"] == "7D" and weekly["partition"]["train_size"] == "23D"
    online = tools.suggest_temporal_partition_policy(spark, path, "timestamp", "online")["suggestion"]
    assert online["initial_train_size"] == "12D" and online["update_size"] == 1
    for bad in ({"objective": "monthly"}, {"time_col": "absent"}):
        with pytest.raises(ValueError):
            tools.suggest_temporal_partition_policy(spark, path, **bad)
    with pytest.raises(ValueError):
        tools.suggest_temporal_partition_policy(spark, spark.createDataFrame([("x",), ("y",)], "timestamp string"), "timestamp")
    assert tools.inspect_and_recommend_local_dataset(spark, path, full_scan=True)["recommendation"]["suggestion"]["time_col"] == "timestamp"
    assert set(tools.compare_temporal_partition_strategies(spark, path, {"a": policy})) == {"a"}
    best = tools.find_train_history_window_baseline(spark, path, "target", "timestamp", "2024-01-20", ["5D", "10D"], "3D")
    assert best["optimal"]["train_rows"] == 5
    assert len(tools.monitor_decay_baseline(spark, path, "target", "timestamp", "2024-01-20", "5D", "2D", "2D", max_windows=3)["records"]) == 3
    assert len(tools.preview_local_dataset(spark, path)["rows"]) == 5


def test_stream(spark, tmp_path):
    rows = spark.range(40).selectExpr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, int(id)) AS ts", "id AS k", "double(id) AS value")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = window_sums(stream, "ts", "value", "10 hours", "0 seconds").writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    found = prequential_mse(spark.table("sums")).orderBy("window_start").collect()
    batch = prequential_mse(window_sums(rows, "ts", "value", "10 hours", "0 seconds")).orderBy("window_start").collect()
    assert found == batch and len(found) >= 3
    assert sessions(rows.withColumn("k", rows["k"] % 2), "ts", "k", "3 hours", "1 hour").count() == 2


def test_engines_and_their_metadata(spark):
    from chronofold.operators.splitting import TemporalBacktestSplitter
    from chronofold.plans.spec import TemporalPartitionSpec
    from chronofold.sources.adapters import PartitionEngine

    pdf = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=9), "v": range(9)})
    found = PartitionEngine.from_input(pdf)
    assert found.metadata.to_dict() == {"engine": "spark", "input_backend": "pandas", "converted": True} and found.columns == ["t", "v"] and found.total_rows == 9 and not found.empty
    assert not PartitionEngine.from_input(spark.createDataFrame(pdf)).metadata.converted
    make = lambda engine: TemporalBacktestSplitter(time_col="t", partition=TemporalPartitionSpec(train_size="3D", test_size="2D"), step="2D", engine=engine)
    assert make("pandas").plan(pdf).materialize().engine_metadata.input_backend == "pandas"
    for call in (lambda: make("duck"), lambda: make("polars").plan(spark.createDataFrame(pdf)), lambda: make("numpy").plan(pa.Table.from_pandas(pdf))):
        with pytest.raises(ValueError):
            call()


def test_time_indexer(daily):
    from chronofold.operators.splitting import TimeIndexer

    index = TimeIndexer(daily(8), "timestamp", ["row_id"])
    assert (index.total_rows, index.min_time.day, index.max_time.day) == (8, 1, 8)
    assert index.timestamp_at(2).day == 3 and index.timestamp_at(-1).day == 8 and index.bounds_between("2024-01-02", "2024-01-05") == (1, 4)
    assert sorted(r["row_id"] for r in index.slice_positional(1, 3).collect()) == [1, 2] and index.slice_between("2024-01-02", "2024-01-05").count() == 3
    with pytest.raises(IndexError):
        index.timestamp_at(8)
