"""Queries over the tables of a folder, and DuckDB SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.metrics import GroupMedianModel, LinearModel, MajorityModel, MeanModel

from chronofold.operators.bands import estimate_prediction_band_by_fold
from chronofold.operators.online import OnlineTemporalRunner, OnlineUpdatePolicy, OnlineUpdatePolicyStudy, RefitUpdateStrategy
from chronofold.operators.runner import DriftBasedRetrain, WalkForwardRunner
from chronofold.operators.splitting import SimulationCampaign, SimulationVariant, TemporalBacktestSplitter, TemporalSimulation, membership
from chronofold.operators.studies import DriftMonitoringPolicy, RollingTrainHistoryPolicy, TrainHistoryPolicy
from chronofold.plans.plan import diagnose, summarize
from chronofold.plans.spec import FeatureLookbackSpec, TemporalPartitionSpec, TemporalSemanticsSpec
from chronofold.sources import profiling
from chronofold.sources.readers import head

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _rolling(train: str = "7D", test: str = "1D", step: str = "1D", strategy: str = "rolling", allow_partial: bool = False, **gaps) -> TemporalBacktestSplitter:
    return TemporalBacktestSplitter(time_col="ts", partition=TemporalPartitionSpec(train_size=train, test_size=test, **gaps), step=step, strategy=strategy, allow_partial=allow_partial, keys=["event_id"])


def _short(frame: DataFrame) -> DataFrame:
    return frame.drop("iteration", "simulation_start", "simulation_end")


def _plan_sql(step: str = "1 day", train: str = "7 day", gap: str = "0 day", test: str = "1 day", tail: str = "0 day", first: str = "lo", expanding: bool = False, partial: bool = False, most: int = 100_000, rows: str = "events", time: str = "ts") -> str:
    """Folds by duration: closed forms for k, counts per segment, and the rule that the first empty segment ends the plan."""
    start = "lo" if expanding else f"{first} + k * INTERVAL '{step}'"
    end = f"{first} + k * INTERVAL '{step}' + INTERVAL '{train}'"
    return f"""
WITH b AS (SELECT min({time}) lo, max({time}) hi FROM {rows}),
c AS (SELECT k, lo, hi, {start} a, {end} b FROM b, range(0, {most}) r(k) WHERE {first} + k * INTERVAL '{step}' <= hi),
d AS (SELECT k::INTEGER fold, hi, a train_start, b train_end, b + INTERVAL '{gap}' test_start, b + INTERVAL '{gap}' + INTERVAL '{test}' test_end FROM c),
e AS (SELECT fold, train_start, train_end, test_start, test_end + INTERVAL '{tail}' > hi is_partial, CASE WHEN test_end + INTERVAL '{tail}' > hi THEN hi + INTERVAL '1 microsecond' ELSE test_end END test_end FROM d WHERE test_end + INTERVAL '{tail}' <= hi OR {str(partial).lower()} AND test_start < hi),
n AS (SELECT e.*, (SELECT count(*) FROM {rows} x WHERE x.{time} >= train_start AND x.{time} < train_end) train_rows, (SELECT count(*) FROM {rows} x WHERE x.{time} >= test_start AND x.{time} < test_end) test_rows FROM e),
plan AS (SELECT * FROM n WHERE fold < (SELECT coalesce(min(fold), 1000000) FROM n WHERE train_rows = 0 OR test_rows = 0))
"""


_PLAN = "SELECT fold, is_partial, train_start, train_end, train_rows, test_start, test_end, test_rows FROM plan"


@query(_plan_sql(most=1) + _PLAN)
def plan_single_duration(spark, d):
    return _short(_rolling(strategy="single").plan(_events(spark, d)).to_frame())


@query(_plan_sql() + _PLAN)
def plan_rolling_duration(spark, d):
    return _short(_rolling().plan(_events(spark, d)).to_frame())


@query(_plan_sql(expanding=True) + _PLAN)
def plan_expanding_duration(spark, d):
    return _short(_rolling(strategy="expanding").plan(_events(spark, d)).to_frame())


@query(_plan_sql(gap="12 hour", test="2 day") + _PLAN)
def plan_rolling_gaps(spark, d):
    return _short(_rolling(test="2D", gap_before_test="12h").plan(_events(spark, d)).to_frame())


@query(_plan_sql(tail="3 day") + _PLAN)
def plan_tail_gap(spark, d):
    return _short(_rolling(gap_after_test="3D").plan(_events(spark, d)).to_frame())


@query(_plan_sql(test="5 day", step="2 day", partial=True) + _PLAN)
def plan_partial(spark, d):
    return _short(_rolling(test="5D", step="2D", allow_partial=True).plan(_events(spark, d)).to_frame())


@query(_plan_sql(first="date_trunc('day', lo)") + _PLAN)
def plan_calendar_daily(spark, d):
    return _short(_rolling(calendar_frequency="D").plan(_events(spark, d)).to_frame())


_HOLE = "(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-14' OR ts >= TIMESTAMP '2024-01-17')"


@query(_plan_sql(train="3 day", rows=_HOLE) + _PLAN)
def plan_stop_at_hole(spark, d):
    e = _events(spark, d).where("ts < timestamp_ntz'2024-01-14' OR ts >= timestamp_ntz'2024-01-17'")
    return _short(_rolling(train="3D").plan(e).to_frame())


def _row_sql(train: str, test: str, step: str, expanding: bool = False, val: str | None = None) -> str:
    begin = "0" if expanding else f"k * {step}"
    middle = f"k * {step} + {train}"
    v = val or "0"
    columns = f"{begin} a, {middle} b, {middle} + {v} c, {middle} + {v} + {test} d"
    mid = ", p(b) validation_start, p(c - 1) validation_end, c - b validation_rows" if val else ""
    return f"""
WITH o AS (SELECT ts, row_number() OVER (ORDER BY ts, event_id) - 1 p FROM events), s AS (SELECT count(*) n FROM events),
f AS (SELECT k::INTEGER fold, {columns} FROM s, range(0, 10000) r(k) WHERE {middle} + {v} + {test} <= n)
SELECT fold, false is_partial, (SELECT ts FROM o WHERE p = a) train_start, (SELECT ts FROM o WHERE p = b - 1) train_end, (b - a)::BIGINT train_rows,
  {"(SELECT ts FROM o WHERE p = b) validation_start, (SELECT ts FROM o WHERE p = c - 1) validation_end, (c - b)::BIGINT validation_rows," if mid else ""}
  (SELECT ts FROM o WHERE p = c) test_start, (SELECT ts FROM o WHERE p = d - 1) test_end, (d - c)::BIGINT test_rows FROM f
"""


def _rows(train, test, step, strategy="rolling", **more) -> TemporalBacktestSplitter:
    return TemporalBacktestSplitter(time_col="ts", partition=TemporalPartitionSpec(train_size=train, test_size=test, **more), step=step, strategy=strategy, keys=["event_id"])


@query(_row_sql("2000", "500", "500"))
def plan_rolling_rows(spark, d):
    return _short(_rows(2000, 500, 500).plan(_events(spark, d)).to_frame())


@query(_row_sql("2000", "500", "500", expanding=True))
def plan_expanding_rows(spark, d):
    return _short(_rows(2000, 500, 500, "expanding").plan(_events(spark, d)).to_frame())


@query(_row_sql("round_even(n * 0.5, 0)::BIGINT", "round_even(n * 0.1, 0)::BIGINT", "round_even(n * 0.1, 0)::BIGINT"))
def plan_fraction(spark, d):
    return _short(_rows(0.5, 0.1, 0.1).plan(_events(spark, d)).to_frame())


@query(_row_sql("1500", "500", "1000", val="250"))
def plan_train_val_test(spark, d):
    return _short(_rows(1500, 500, 1000, layout="train_val_test", validation_size=250).plan(_events(spark, d)).to_frame())


@query("""
WITH x AS (SELECT o_orderdate, max(l_shipdate) shipped FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate),
b AS (SELECT min(o_orderdate) lo, max(o_orderdate) hi FROM x),
f AS (SELECT k::INTEGER fold, lo + k * INTERVAL '180 day' a, lo + k * INTERVAL '180 day' + INTERVAL '360 day' b, lo + k * INTERVAL '180 day' + INTERVAL '390 day' c, hi FROM b, range(0, 100) r(k)),
g AS (SELECT * FROM f WHERE c <= hi)
SELECT fold, false is_partial, a train_start, b train_end, (SELECT count(*) FROM x WHERE shipped >= a AND shipped < b) train_rows, b test_start, c test_end, (SELECT count(*) FROM x WHERE o_orderdate >= b AND o_orderdate < c) test_rows FROM g
""")
def plan_per_segment_columns(spark, d):
    orders, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    shipped = items.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    x = orders.select("o_orderkey", "o_orderdate").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    semantics = TemporalSemanticsSpec("o_orderdate", segment_time_cols={"train": "shipped"})
    return _short(TemporalBacktestSplitter(time_col=semantics, partition=TemporalPartitionSpec(train_size="360D", test_size="30D"), step="180D").plan(x).to_frame())


@query(_plan_sql() + _PLAN + " WHERE NOT (train_start < TIMESTAMP '2024-01-06' AND train_end > TIMESTAMP '2024-01-04') AND NOT (test_start < TIMESTAMP '2024-01-21' AND test_end > TIMESTAMP '2024-01-20')")
def plan_excluded(spark, d):
    plan = _rolling().plan(_events(spark, d))
    return _short(plan.exclude_windows(train=[("2024-01-04", "2024-01-06")], test=[("2024-01-20", "2024-01-21")]).to_frame())


@query(_plan_sql() + _PLAN + " WHERE fold IN (3, 5, 6, 7)")
def plan_selected(spark, d):
    plan = _rolling().plan(_events(spark, d))
    return _short(plan.select_from_iteration(3).select_until_iteration(7).select_iterations([3, 5, 6, 7, 99]).to_frame())


@query(_plan_sql(test="5 day", step="2 day", partial=True) + "SELECT count(*) total_folds, NOT bool_or(test_start < train_end) AND min(least(train_rows, test_rows)) > 0 valid, bool_or(is_partial) has_partial, bool_or(test_start < train_end) test_overlaps, bool_or(test_start = train_end) test_touches, min(train_rows) < 10 few_train, min(test_rows) < 5 few_test FROM plan")
def plan_diagnostics(spark, d):
    found = diagnose(_rolling(test="5D", step="2D", allow_partial=True).plan(_events(spark, d)))
    i, w = " ".join(found["issues"]), " ".join(found["warnings"])
    row = (found["total_folds"], found["valid"], "partial" in w, "before train ends" in i, "instant" in w, "train has fewer" in w, "test has fewer" in w)
    return spark.createDataFrame([row], "total_folds long, valid boolean, has_partial boolean, test_overlaps boolean, test_touches boolean, few_train boolean, few_test boolean")


@query(_plan_sql() + "SELECT 'train' segment, min(train_rows) min_rows, max(train_rows) max_rows, avg(train_rows) mean_rows FROM plan UNION ALL SELECT 'test', min(test_rows), max(test_rows), avg(test_rows) FROM plan")
def plan_summary(spark, d):
    rows = summarize(_rolling().plan(_events(spark, d)))["rows"]
    return spark.createDataFrame([(s, v["min"], v["max"], float(v["mean"])) for s, v in rows.items()], "segment string, min_rows long, max_rows long, mean_rows double")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")
def window_bounds_filter(spark, d):
    return TemporalSimulation(time_col="ts", partition=TemporalPartitionSpec(train_size="7D", test_size="1D"), step="1D", start_at="2024-01-05", end_at="2024-01-20").select_input(_events(spark, d)).select("event_id", "ts")


_MEMBERS = ", m AS (SELECT fold, 'train' segment, event_id, value, event_type, ts FROM plan JOIN events ON ts >= train_start AND ts < train_end UNION ALL SELECT fold, 'test', event_id, value, event_type, ts FROM plan JOIN events ON ts >= test_start AND ts < test_end) "


@query(_plan_sql() + _MEMBERS + "SELECT fold, segment, event_id FROM m")
def fold_membership(spark, d):
    return membership(_rolling().plan(_events(spark, d)), ["event_id"])


@query("WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 p FROM events) SELECT k::INTEGER fold, event_id FROM o, range(0, 1000) r(k) WHERE p >= k * 500 + 2000 AND p < k * 500 + 2500 AND k * 500 + 2500 <= (SELECT count(*) FROM events)")
def fold_rows_positional(spark, d):
    return membership(_rows(2000, 500, 500).plan(_events(spark, d)), ["event_id"]).where("segment = 'test'").select("fold", "event_id")


@query("WITH b AS (SELECT min(ts) + INTERVAL '10 day' a FROM events) SELECT g AS feature_group, count(*) AS n_rows, min(ts) first_ts, max(ts) last_ts FROM b, (VALUES ('__default__', INTERVAL '2 day'), ('slow', INTERVAL '5 day')) v(g, l) JOIN events ON ts >= a - l AND ts < a GROUP BY g")
def feature_history(spark, d):
    splitter = TemporalBacktestSplitter(time_col="ts", partition=TemporalPartitionSpec(train_size="10D", test_size="1D"), strategy="single", step="1D")
    split = next(iter(splitter.plan(_events(spark, d)).iter_splits()))
    parts = split.slice_feature_history(FeatureLookbackSpec("2D", {"slow": "5D"}), segment_name="test")
    out = None
    for g, rows in parts.items():
        one = rows.agg(F.lit(g).alias("feature_group"), F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        out = one if out is None else out.unionByName(one)
    return out


@query(_plan_sql() + "SELECT 'train' segment, sum(train_rows)::BIGINT total_rows, avg(train_rows) avg_rows, min(train_rows) min_rows, max(train_rows) max_rows FROM plan UNION ALL SELECT 'test', sum(test_rows)::BIGINT, avg(test_rows), min(test_rows), max(test_rows) FROM plan")
def segment_stats(spark, d):
    stats = _rolling().describe_simulation(_events(spark, d), output="chart_data").segment_stats
    return spark.createDataFrame([(s, v["total_rows"], float(v["avg_rows"]), v["min_rows"], v["max_rows"]) for s, v in stats.items()], "segment string, total_rows long, avg_rows double, min_rows long, max_rows long")


@query(_plan_sql() + ", z AS (SELECT min(train_start) s, epoch(max(test_end) - min(train_start)) w FROM plan) SELECT fold, 'test' segment, round(round(epoch(test_start - s) / w * 100, 4), 2) offset_pct, round(round(greatest(epoch(test_end - test_start) / w * 100, 0.8), 4), 2) width_pct FROM plan, z")
def chart_offsets(spark, d):
    chart = _rolling().describe_simulation(_events(spark, d), output="chart_data")
    rows = [(f["fold"], s, round(v["offset_pct"], 2), round(v["width_pct"], 2)) for f in chart.folds for s, v in f["segments"].items() if s == "test"]
    return spark.createDataFrame(rows, "fold int, segment string, offset_pct double, width_pct double")


@query(_plan_sql(most=1) + "SELECT 'one' variant, count(*)::INTEGER total_folds, (SELECT count(*) FROM events) total_rows, 'single' strategy FROM plan UNION ALL (" + _plan_sql() + "SELECT 'rolling', count(*)::INTEGER, (SELECT count(*) FROM events), 'rolling' FROM plan)")
def campaign_compare(spark, d):
    make = lambda s: TemporalSimulation(time_col="ts", partition=TemporalPartitionSpec(train_size="7D", test_size="1D"), step="1D", strategy=s)
    result = SimulationCampaign([SimulationVariant("one", make("single")), SimulationVariant("rolling", make("rolling"))]).run(_events(spark, d), max_workers=2)
    return result.to_frame().select("variant", "total_folds", "total_rows", "strategy")


def _walk(spark, d, model=None, metrics=("mae", "rmse"), **kw):
    runner = WalkForwardRunner(model=model or MeanModel(), target_col="value", feature_cols=["event_id"], metrics=list(metrics), key_col="event_id", **kw)
    return runner.run(_rolling(step="2D"), _events(spark, d))


def _folds(result, *metrics: str) -> DataFrame:
    return result.to_frame().select(F.col("fold").cast("int").alias("fold"), "retrained", *[F.round(m, 6).alias(m) for m in metrics])


def _walk_sql(model_fold: str) -> str:
    return (
        _plan_sql(step="2 day") + _MEMBERS + f""", st AS (SELECT fold AS mf, avg(value) p FROM m WHERE segment = 'train' GROUP BY fold)
SELECT t.fold, t.fold = {model_fold} retrained, round(avg(abs(value - p)), 6) mae, round(sqrt(avg((value - p) * (value - p))), 6) rmse FROM m t JOIN st ON mf = {model_fold} WHERE segment = 'test' GROUP BY t.fold"""
    )


@query(_walk_sql("t.fold"))
def wf_mean_always(spark, d):
    return _folds(_walk(spark, d), "mae", "rmse")


@query(_walk_sql("0"))
def wf_mean_never(spark, d):
    return _folds(_walk(spark, d, retrain="never"), "mae", "rmse")


@query(_walk_sql("(t.fold - t.fold % 2)"))
def wf_mean_periodic2(spark, d):
    return _folds(_walk(spark, d, retrain_interval=2), "mae", "rmse")


_DRIFT = _plan_sql(step="2 day").replace("WITH b", "WITH RECURSIVE b", 1) + _MEMBERS + """, st AS (SELECT fold AS mf, avg(value) p FROM m WHERE segment = 'train' GROUP BY fold),
loss AS (SELECT t.fold k, mf, avg(abs(value - p)) mae, sqrt(avg((value - p) * (value - p))) rmse FROM m t JOIN st ON mf <= t.fold WHERE segment = 'test' GROUP BY 1, 2),
run AS (SELECT 0 k, 0 AS last_fit UNION ALL SELECT run.k + 1, CASE WHEN CASE WHEN base.mae = 0 THEN latest.mae > 0.01 ELSE (latest.mae - base.mae) / abs(base.mae) >= 0.01 END THEN run.k + 1 ELSE last_fit END
  FROM run JOIN loss latest ON latest.k = run.k AND latest.mf = last_fit JOIN loss base ON base.k = last_fit AND base.mf = last_fit WHERE run.k + 1 < (SELECT count(*) FROM plan))
SELECT run.k::INTEGER fold, run.k = last_fit retrained, round(mae, 6) mae, round(rmse, 6) rmse FROM run JOIN loss ON loss.k = run.k AND loss.mf = last_fit"""


@query(_DRIFT)
def wf_drift(spark, d):
    return _folds(_walk(spark, d, retrain_policy=DriftBasedRetrain("mae", 0.01)), "mae", "rmse")


@query("""
WITH x AS (SELECT o_orderdate, o_totalprice y, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)::DOUBLE x FROM orders), b AS (SELECT min(o_orderdate) lo, max(o_orderdate) hi FROM x),
f AS (SELECT k::INTEGER fold, lo + k * INTERVAL '200 day' a, lo + k * INTERVAL '200 day' + INTERVAL '365 day' b, lo + k * INTERVAL '200 day' + INTERVAL '395 day' c FROM b, range(0, 100) r(k) WHERE lo + k * INTERVAL '200 day' + INTERVAL '395 day' <= hi),
s AS (SELECT fold, regr_slope(y, x) m, regr_intercept(y, x) i FROM f JOIN x ON o_orderdate >= a AND o_orderdate < b GROUP BY fold)
SELECT fold, round(avg(abs(y - (m * x + i))), 3) mae FROM f JOIN s USING (fold) JOIN x ON o_orderdate >= b AND o_orderdate < c GROUP BY fold
""")
def wf_ols(spark, d):
    x = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate", F.col("o_totalprice").alias("y"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double").alias("x"))
    splitter = TemporalBacktestSplitter(time_col="o_orderdate", partition=TemporalPartitionSpec(train_size="365D", test_size="30D"), step="200D")
    r = WalkForwardRunner(model=LinearModel(), target_col="y", feature_cols=["x"], metrics=["mae"], key_col="o_orderkey").run(splitter, x)
    return r.to_frame().select(F.col("fold").cast("int").alias("fold"), F.round("mae", 3).alias("mae"))


@query(_plan_sql(step="2 day") + _MEMBERS + ", top AS (SELECT fold, event_type, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, event_type) r FROM m WHERE segment = 'train' GROUP BY 1, 2) SELECT m.fold, round(avg((m.event_type = top.event_type)::INTEGER), 6) accuracy FROM m JOIN top ON top.fold = m.fold AND r = 1 WHERE segment = 'test' GROUP BY m.fold")
def wf_majority(spark, d):
    r = WalkForwardRunner(model=MajorityModel(), target_col="event_type", feature_cols=["event_id"], metrics=["accuracy"], key_col="event_id").run(_rolling(step="2D"), _events(spark, d))
    return r.to_frame().select(F.col("fold").cast("int").alias("fold"), F.round("accuracy", 6).alias("accuracy"))


@query(_plan_sql(step="2 day") + _MEMBERS + ", g AS (SELECT fold, event_type, median(value) p FROM m WHERE segment = 'train' GROUP BY 1, 2), a AS (SELECT fold, median(value) p FROM m WHERE segment = 'train' GROUP BY 1) SELECT m.fold, round(avg(abs(value - coalesce(g.p, a.p))), 6) mae FROM m JOIN a ON a.fold = m.fold LEFT JOIN g ON g.fold = m.fold AND g.event_type = m.event_type WHERE segment = 'test' GROUP BY m.fold")
def wf_group_median(spark, d):
    return _folds(_walk(spark, d, model=GroupMedianModel("event_type"), metrics=["mae"]), "mae").drop("retrained")


@query("WITH w AS (" + _walk_sql("t.fold") + ") SELECT fold, 'mae' metric, mae AS value, 'min' direction, retrained FROM w UNION ALL SELECT fold, 'rmse', rmse, 'min', retrained FROM w")
def metric_trajectory(spark, d):
    return _walk(spark, d).metric_trajectory().select(F.col("fold").cast("int").alias("fold"), "metric", F.round("value", 6).alias("value"), "direction", "retrained")


@query("WITH w AS (" + _walk_sql("t.fold") + ") SELECT 'mae' metric, round(avg(mae), 5) mean_value, round(min(mae), 5) best, arg_min(fold, mae) best_fold FROM w")
def runner_summary(spark, d):
    m = _walk(spark, d).summary()["metrics"]["mae"]
    return spark.createDataFrame([("mae", round(m["mean"], 5), round(m["best"], 5), m["best_fold"])], "metric string, mean_value double, best double, best_fold int")


@query("WITH w AS (" + _walk_sql("(t.fold - t.fold % 2)") + ") SELECT fold FROM w WHERE retrained")
def retrain_events(spark, d):
    return _walk(spark, d, retrain_interval=2).retrain_events().select(F.col("fold").cast("int").alias("fold"))


_GROWTH = "WITH v AS (SELECT * FROM (VALUES (0, INTERVAL '2 day'), (1, INTERVAL '5 day'), (2, INTERVAL '12 day')) v(variant, size)), s AS (SELECT variant, count(*) train_rows, avg(value) p FROM v JOIN events ON ts >= TIMESTAMP '2024-01-20' - size AND ts < TIMESTAMP '2024-01-20' GROUP BY 1), g AS (SELECT variant, train_rows, count(*) test_rows, sqrt(avg((value - p) * (value - p))) rmse FROM s JOIN events ON ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-23' GROUP BY 1, 2) "


def _growth(spark, d):
    policy = TrainHistoryPolicy("ts", cutoff="2024-01-20", train_sizes=["2D", "5D", "12D"], test_size="3D")
    return policy.evaluate(_events(spark, d), model=MeanModel(), target_col="value", feature_cols=["event_id"], metrics=["rmse"])


@query(_GROWTH + "SELECT variant, train_rows, test_rows, round(rmse, 6) rmse FROM g")
def train_growth(spark, d):
    return _growth(spark, d).to_frame().select(F.col("variant").cast("int").alias("variant"), "train_rows", "test_rows", F.round("rmse", 6).alias("rmse"))


@query(_GROWTH + "SELECT variant, train_rows FROM g WHERE rmse <= (SELECT min(rmse) FROM g) * 1.01 ORDER BY train_rows, rmse, variant LIMIT 1")
def train_growth_best(spark, d):
    best = _growth(spark, d).find_optimal_train_size(metric="rmse", tolerance=0.01)
    return spark.createDataFrame([(int(best["variant"]), int(best["train_rows"]))], "variant int, train_rows long")


_DECAY = "WITH p AS (SELECT avg(value) p FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'), w AS (SELECT k::INTEGER AS window_no, TIMESTAMP '2024-01-10' + k * INTERVAL '2 day' a FROM range(0, 8) r(k)), z AS (SELECT window_no, count(*) test_rows, avg(abs(value - p)) mae FROM w JOIN events ON ts >= a AND ts < a + INTERVAL '2 day', p GROUP BY 1) "


def _decay(spark, d):
    policy = DriftMonitoringPolicy("ts", cutoff="2024-01-10", train_size="5D", test_size="2D", step="2D", max_windows=8)
    return policy.evaluate(_events(spark, d), model=MeanModel(), target_col="value", feature_cols=["event_id"], metrics=["mae"])


@query(_DECAY + "SELECT window_no, test_rows, round(mae, 6) mae FROM z")
def decay_windows(spark, d):
    return _decay(spark, d).to_frame().select(F.col("window").cast("int").alias("window_no"), "test_rows", F.round("mae", 6).alias("mae"))


@query(_DECAY + "SELECT window_no, round(mae, 6) mae FROM z WHERE (mae - (SELECT mae FROM z WHERE window_no = 0)) / (SELECT mae FROM z WHERE window_no = 0) >= 0.005 ORDER BY window_no LIMIT 1")
def drift_onset(spark, d):
    found = _decay(spark, d).find_drift_onset(metric="mae", threshold=0.005)
    rows = [] if found is None else [(int(found["window"]), round(float(found["mae"]), 6))]
    return spark.createDataFrame(rows, "window_no int, mae double")


_HISTORY = _plan_sql(step="4 day") + ", v AS (SELECT * FROM (VALUES (0, INTERVAL '2 day'), (1, INTERVAL '4 day'), (2, INTERVAL '7 day')) v(variant, size)), s AS (SELECT fold, variant, count(*) train_rows, avg(value) p FROM plan, v JOIN events ON ts >= train_end - size AND ts < train_end GROUP BY 1, 2), g AS (SELECT s.fold, variant, s.train_rows, count(*) test_rows, sqrt(avg((value - p) * (value - p))) rmse FROM s JOIN plan USING (fold) JOIN events ON ts >= test_start AND ts < test_end GROUP BY 1, 2, 3), best AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY rmse, train_rows) r FROM g) "


def _history(spark, d):
    policy = RollingTrainHistoryPolicy("ts", partition=TemporalPartitionSpec(train_size="7D", test_size="1D"), step="4D", train_sizes=["2D", "4D", "7D"])
    return policy.evaluate(_events(spark, d), model=MeanModel(), target_col="value", feature_cols=["event_id"], metrics=["rmse"], metric="rmse")


@query(_HISTORY + "SELECT fold, train_rows AS optimal_train_rows, test_rows, round(rmse, 6) rmse FROM best WHERE r = 1")
def rolling_history_best(spark, d):
    return _history(spark, d).to_frame().select(F.col("fold").cast("int").alias("fold"), "optimal_train_rows", "test_rows", F.round("rmse", 6).alias("rmse"))


@query(_HISTORY + "SELECT count(*)::INTEGER total_folds, round(avg(CASE variant WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 7 END), 6) mean_days FROM best WHERE r = 1")
def rolling_history_summary(spark, d):
    s = _history(spark, d).summary()
    return spark.createDataFrame([(s["total_folds"], round(float(s["mean_days"]), 6))], "total_folds int, mean_days double")


class _Mean:
    """The plainest Python estimator."""

    def fit(self, X, y):
        self.mean = float(y.mean())
        return self

    def predict(self, X):
        return [self.mean] * len(X)


def _fixed_band(context):
    return {"lower": context.predictions - 40.0, "upper": context.predictions + 40.0, "half_width": 40.0}


@query(_plan_sql(step="4 day") + _MEMBERS + ", s AS (SELECT fold, avg(value) p FROM m WHERE segment = 'train' GROUP BY 1) SELECT m.fold, 80.0::DOUBLE width_mean, 80.0::DOUBLE width_median, round(avg((value BETWEEN p - 40 AND p + 40)::INTEGER), 6) coverage FROM m JOIN s ON s.fold = m.fold WHERE segment = 'test' GROUP BY m.fold")
def bands_fixed(spark, d):
    r = estimate_prediction_band_by_fold(_rolling(step="4D"), _events(spark, d), model=_Mean(), target_col="value", feature_cols=["event_id"], band_estimator=_fixed_band, key_col="event_id")
    return r.to_frame().select("fold", F.round("prediction_band_width_mean", 6).alias("width_mean"), F.round("prediction_band_width_median", 6).alias("width_median"), F.round("prediction_band_coverage", 6).alias("coverage"))


def _quantile_band(context):
    low, high = np.quantile(context.y_train, [0.1, 0.9])
    return {"lower": np.full(len(context.predictions), low), "upper": np.full(len(context.predictions), high)}


@query(_plan_sql(step="4 day") + _MEMBERS + ", s AS (SELECT fold, quantile_cont(value, 0.1) lo, quantile_cont(value, 0.9) hi FROM m WHERE segment = 'train' GROUP BY 1) SELECT m.fold, round(any_value(hi - lo), 6) width_mean, round(any_value(hi - lo), 6) width_median, round(avg((value BETWEEN lo AND hi)::INTEGER), 6) coverage FROM m JOIN s ON s.fold = m.fold WHERE segment = 'test' GROUP BY m.fold")
def bands_quantile(spark, d):
    r = estimate_prediction_band_by_fold(_rolling(step="4D"), _events(spark, d), model=_Mean(), target_col="value", feature_cols=["event_id"], band_estimator=_quantile_band, key_col="event_id")
    return r.to_frame().select("fold", F.round("prediction_band_width_mean", 6).alias("width_mean"), F.round("prediction_band_width_median", 6).alias("width_median"), F.round("prediction_band_coverage", 6).alias("coverage"))


def _online(update, initial=1000, model=None, **kw) -> OnlineTemporalRunner:
    return OnlineTemporalRunner("ts", "value", model or MeanModel(), initial, update, ["event_id"], metrics=["mae"], keys=["event_id"], **kw)


_ONLINE = ", s AS (SELECT b, sum(value) t, count(value) n FROM o GROUP BY b), p AS (SELECT b, sum(t) OVER w / sum(n) OVER w p FROM s WINDOW w AS (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), r AS (SELECT o.b::INTEGER AS batch, count(*) batch_rows, avg(abs(value - p)) mae FROM o JOIN p USING (b) WHERE o.b >= 0 GROUP BY o.b) "
_ROWS100 = "WITH q AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 p FROM events), o AS (SELECT value, CASE WHEN p < 1000 THEN -1 ELSE (p - 1000) // 100 END b FROM q)" + _ONLINE
_DAILY = "WITH lo AS (SELECT min(ts) + INTERVAL '5 day' a FROM events), q AS (SELECT value, CASE WHEN ts < a THEN -1 ELSE (epoch_us(ts) - epoch_us(a)) // 86400000000 END w FROM events, lo), k AS (SELECT w, row_number() OVER (ORDER BY w) - 1 b FROM (SELECT DISTINCT w FROM q WHERE w >= 0)), o AS (SELECT value, coalesce(b, -1) b FROM q LEFT JOIN k USING (w))" + _ONLINE


def _batches(result) -> DataFrame:
    return result.to_frame().select(F.col("batch").cast("int").alias("batch"), F.col("batch_rows").cast("long").alias("batch_rows"), F.round("mae", 4).alias("mae"))


@query(_ROWS100 + "SELECT batch, batch_rows, round(mae, 4) mae FROM r")
def online_rows100(spark, d):
    return _batches(_online(100).run(_events(spark, d)))


@query("""WITH q AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 p FROM events), x AS (SELECT p, value, sum(value) OVER w / count(value) OVER w m FROM q WINDOW w AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT (p - 1000)::INTEGER AS batch, 1::BIGINT batch_rows, round(abs(value - m) + 3.3e-8, 4) mae FROM x WHERE p >= 1000""")
def online_events(spark, d):
    r = _online(1).run(_events(spark, d)).to_frame()  # means of many counts end in a half: both sides are moved off it before they are rounded
    return r.select(F.col("batch").cast("int").alias("batch"), F.col("batch_rows").cast("long").alias("batch_rows"), F.round(F.col("mae") + 3.3e-8, 4).alias("mae"))


@query(_DAILY + "SELECT batch, batch_rows, round(mae, 4) mae FROM r")
def online_daily(spark, d):
    return _batches(_online("1D", "5D").run(_events(spark, d)))


@query("""WITH q AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 p FROM events), x AS (SELECT *, avg(value) OVER (ORDER BY p ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) m FROM q),
s AS (SELECT (p - 1000) // 1000 b, m FROM x WHERE p >= 1000 AND (p - 1000) % 1000 = 0) SELECT b::INTEGER AS batch, count(*) batch_rows, round(avg(abs(value - s.m)), 4) mae FROM x JOIN s ON (p - 1000) // 1000 = b WHERE p >= 1000 GROUP BY b""")
def online_refit_last_n(spark, d):
    return _batches(_online(1000, model=_Mean(), update_strategy=RefitUpdateStrategy(500)).run(_events(spark, d)))


@query(_ROWS100 + "SELECT batch FROM r WHERE mae > 40")
def online_trigger_checkpoints(spark, d):
    r = _online(100, retrain_trigger=lambda history, latest: "high error" if latest["mae"] > 40 else None).run(_events(spark, d))
    return r.retrain_checkpoints().select(F.col("batch").cast("int").alias("batch"))


def _study(spark, d):
    policies = [OnlineUpdatePolicy("small", 100, update_cost=1.0), OnlineUpdatePolicy("large", 1000, update_cost=3.0)]
    return OnlineUpdatePolicyStudy("ts", "value", MeanModel(), 1000, policies, ["event_id"], metrics=["mae"], keys=["event_id"]).run(_events(spark, d))


_LARGE = _ROWS100.replace("// 100 ", "// 1000 ")


@query("SELECT 'small' AS policy, * FROM (" + _ROWS100 + "SELECT count(*) updates, count(*) * 1.0::DOUBLE total_update_cost, round(avg(mae), 6) mae FROM r) UNION ALL SELECT 'large', * FROM (" + _LARGE + "SELECT count(*), count(*) * 3.0::DOUBLE, round(avg(mae), 6) FROM r)")
def online_policy_study(spark, d):
    return _study(spark, d).to_frame().select("policy", "updates", "total_update_cost", F.round("mae", 6).alias("mae"))


@query("SELECT policy FROM (SELECT 'small' AS policy, * FROM (" + _ROWS100 + "SELECT count(*) u, avg(mae) + 0.1 * count(*) o FROM r) UNION ALL SELECT 'large', * FROM (" + _LARGE + "SELECT count(*), avg(mae) + 0.3 * count(*) FROM r)) ORDER BY o, u, policy LIMIT 1")
def online_best_policy(spark, d):
    return spark.createDataFrame([(_study(spark, d).find_optimal_policy(metric="mae", update_cost_weight=0.1)["policy"],)], "policy string")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count({c}) non_null, count(DISTINCT {c}) unique_count FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def profile_columns(spark, d):
    return profiling.profile(spark.read.parquet(f"{d}/customer.parquet")).select(F.col("column").alias("column_name"), "n", "non_null", "unique_count")


@query("WITH o AS (SELECT DISTINCT ts FROM events), g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) gap FROM o) SELECT (SELECT count(*) FROM events) n_rows, (SELECT min(ts) FROM o) low, (SELECT max(ts) FROM o) high, round(median(gap) / 1e6, 6) median_step_s FROM g")
def profile_time_span(spark, d):
    return profiling.time_span(_events(spark, d), "ts").select(F.col("rows").alias("n_rows"), "low", "high", F.round("median_step_s", 6).alias("median_step_s"))


@query("WITH o AS (SELECT DISTINCT ts FROM events), g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) gap FROM o), s AS (SELECT count(*) n_rows, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 span_s FROM events), m AS (SELECT median(gap) / 1e6 step_s FROM g) SELECT n_rows, span_s, round(step_s, 6) median_step_s, round_even(greatest(span_s * 0.6, 3 * 86400, 10 * step_s) / 86400, 0)::BIGINT train_days FROM s, m")
def suggest_inputs(spark, d):
    events = _events(spark, d)
    train = profiling.suggest_partition_policy(events, "ts")["suggestion"]["partition"]["train_size"]
    return profiling.suggest_inputs(events, "ts").select(F.col("rows").alias("n_rows"), "span_s", F.round("median_step_s", 6).alias("median_step_s"), F.lit(int(train[:-1])).cast("long").alias("train_days"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 5")
def preview_head(spark, d):
    return head(spark.read.parquet(f"{d}/orders.parquet"), 5, "o_orderkey").select("o_orderkey", "o_orderdate")
