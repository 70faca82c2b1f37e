import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronofold import FeatureLookbackSpec, SimulationCampaign, SimulationVariant, TemporalBacktestSplitter, TemporalPartitionSpec, TemporalSemanticsSpec, TemporalSimulation
from chronofold.operators.splitting import membership
from chronofold.plans.plan import diagnose


def splitter(train="3D", test="2D", step="1D", strategy="rolling", partial=False, **gaps):
    return TemporalBacktestSplitter(time_col="timestamp", partition=TemporalPartitionSpec(train_size=train, test_size=test, **gaps), step=step, strategy=strategy, allow_partial=partial, keys=["row_id"])


def ids(df):
    return sorted(r["row_id"] for r in df.select("row_id").collect())


def test_gap_and_counts(daily):
    plan = splitter(gap_before_test="1D").plan(daily(8))
    assert [f.boundaries["train"].start.day for f in plan.folds] == [1, 2]
    assert [f.boundaries["test"].start.day for f in plan.folds] == [5, 6]
    assert [list(f.counts.values()) for f in plan.folds] == [[3, 2], [3, 2]]


def test_plan_filters(daily):
    plan = splitter().plan(daily(12))
    assert len(plan) == 7 and plan.to_frame().count() == 7
    assert [f.iteration for f in plan.exclude_windows(train=[("2024-01-02", "2024-01-04")]).folds] == [3, 4, 5, 6]
    assert [f.iteration for f in plan.select_from_iteration(2).select_until_iteration(4).select_iterations([3, 9]).folds] == [3]
    with pytest.raises(ValueError):
        plan.exclude_windows(test=[("2024-01-04", "2024-01-04")])
    with pytest.raises(ValueError):
        plan.select_iterations([]).materialize()
    found = diagnose(plan)  # fewer than ten train rows are only worth a look
    assert found["valid"] and not found["issues"] and any("train has fewer" in w for w in found["warnings"]) and any("instant" in w for w in found["warnings"])


def test_rows_of_unsorted_and_tied_input(spark, daily):
    df = daily(8).orderBy(F.desc("feature"))
    first = next(splitter(3, 2, 2).iter_splits(df))
    assert ids(first.segment("train")) == [0, 1, 2] and ids(first.segment("test")) == [3, 4]
    tied = spark.range(10).select(F.col("id").alias("row_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("timestamp"))
    train, test = next(splitter(6, 4, 4).split(tied))
    assert ids(train) == [0, 1, 2, 3, 4, 5] and ids(test) == [6, 7, 8, 9]


def test_calendar(spark):
    times = ["2024-01-01 05:21", "2024-01-01 12:00", "2024-01-02 06:00", "2024-01-02 18:00", "2024-01-03 07:00"]
    df = spark.createDataFrame(list(enumerate(times)), "row_id long, timestamp string")
    s = next(splitter("1D", "1D", calendar_frequency="D").iter_splits(df))
    assert ids(s.segment("train")) == [0, 1] and ids(s.segment("test")) == [2, 3]
    assert s.boundaries["train"].start == dt.datetime(2024, 1, 1)


def test_segment_columns(spark):
    day = lambda m, d: dt.datetime(2025, m, d)
    rows = [(i, day(9, 1 + i), day(9, a)) for i, a in enumerate([2, 3, 4, 8, 9, 10, 11])]
    df = spark.createDataFrame(rows, "row_id long, departed timestamp_ntz, arrived timestamp_ntz")
    semantics = TemporalSemanticsSpec("departed", segment_time_cols={"train": "arrived"})
    s = TemporalBacktestSplitter(time_col=semantics, partition=TemporalPartitionSpec(train_size="4D", test_size="2D"), step="1D", strategy="single").iter_splits(df)
    s = next(s)
    assert ids(s.segment("train")) == [0, 1, 2] and ids(s.segment("test")) == [4, 5]


def test_hole_ends_the_plan_and_nulls_are_left_out(spark, daily):
    df = daily(20).where("row_id < 8 OR row_id > 12")
    df = df.union(spark.sql("SELECT 99L, CAST(NULL AS timestamp_ntz), 0L, 0L"))
    plan = splitter().plan(df)
    assert [f.iteration for f in plan.folds] == [0, 1, 2, 3, 4]
    assert 99 not in ids(plan.split_of(plan.folds[0]).segment("train"))


def test_partial_and_tail(daily):
    assert [f.counts["test"] for f in splitter("5D", "5D", "5D", partial=True).plan(daily(9)).folds] == [4]
    assert [f.counts["test"] for f in splitter("3D", "2D", "9D", partial=True, gap_after_test="5D").plan(daily(10)).folds] == [7]


def test_errors(spark, daily):
    with pytest.raises(ValueError):
        splitter().plan(daily(0))
    with pytest.raises(ValueError):
        splitter("1D", "20D", strategy="expanding", gap_before_test="2D").plan(daily(12))
    with pytest.raises(ValueError):
        splitter().get_n_splits()
    with pytest.raises(ValueError):
        TemporalBacktestSplitter(time_col="absent", partition=TemporalPartitionSpec(train_size="1D", test_size="1D"), step="1D").plan(daily(5))
    with pytest.raises(TypeError):
        splitter().plan(42)


@pytest.mark.parametrize("strategy", ["rolling", "expanding"])
@pytest.mark.parametrize("sizes", [("3D", "2D", "2D"), (4, 2, 3)])
def test_membership_has_the_planned_counts(daily, strategy, sizes):
    plan = splitter(*sizes, strategy=strategy).plan(daily(17))
    found = {(r["fold"], r["segment"]): r["count"] for r in membership(plan, ["row_id"]).groupBy("fold", "segment").count().collect()}
    assert found == {(f.iteration, s): n for f in plan.folds for s, n in f.counts.items()}
    for f in plan.folds:
        assert {s: plan.split_of(f).segment(s).count() for s in f.counts} == f.counts


def test_simulation_bounds_and_campaign(daily):
    make = lambda **k: TemporalSimulation(time_col="timestamp", partition=TemporalPartitionSpec(train_size="3D", test_size="2D"), step="1D", **k)
    sim = make(start_at="2024-01-03", end_at="2024-01-10", max_folds=2)
    assert sim.select_input(daily(20)).count() == 8 and sim.run(daily(20)).total_folds == 2
    with pytest.raises(ValueError):
        make(max_folds=0)
    out = SimulationCampaign([SimulationVariant("a", make()), SimulationVariant("b", make(strategy="single"))]).run(daily(12), max_workers=2)
    assert [r["total_folds"] for r in out.to_frame().collect()] == [7, 1] and out.result_for("b").total_folds == 1
    with pytest.raises(ValueError):
        SimulationCampaign([SimulationVariant("a", make()), SimulationVariant("a", make())])


def test_lookback(daily):
    s = next(splitter("10D", "5D").iter_splits(daily(30)))
    look = FeatureLookbackSpec("2D", {"slow": "5D"})
    b = s.feature_history_bounds(look, "test")
    assert (b["__default__"].start.day, b["slow"].start.day, b["slow"].end.day) == (9, 6, 11)
    assert {g: df.count() for g, df in s.slice_feature_history(look, segment_name="test").items()} == {"__default__": 2, "slow": 5}


def test_filter_reaches_the_scan(spark, daily, tmp_path):
    daily(20).write.parquet(str(tmp_path / "t"))
    s = next(splitter().iter_splits(spark.read.parquet(str(tmp_path / "t"))))
    text = s.segment("train").select("feature")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in text and "LessThan(timestamp" in text
