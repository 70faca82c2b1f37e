"""Folds over a DataFrame: splitter, fold handles, simulations and campaigns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.timeline import POSITION, as_time, at, between, named, resolve, us, with_position
from chronofold.operators.counting import Histogram
from chronofold.operators.reporting import SimulationChartData, SimulationSummary, build_summary
from chronofold.plans.geometry import duration_windows, row_windows
from chronofold.plans.plan import PartitionPlan, PlannedFold
from chronofold.plans.spec import FeatureLookbackSpec, SegmentBoundaries, TemporalPartitionSpec, TemporalSemanticsSpec, common_step, instant, instant_us, validate_partition_spec, validate_step, validate_strategy, validate_temporal_semantics
from chronofold.sources.adapters import ENGINES, PartitionEngine, PartitionEngineMetadata, coerce_tabular_input


@dataclass(frozen=True)
class TimeSplit:
    """One fold of a DataFrame; a segment is a filter on it, read when an action asks for it."""

    fold: int
    frame: DataFrame
    boundaries: dict[str, SegmentBoundaries]
    bounds: dict[str, tuple[int, int]]
    counts: dict[str, int]
    semantics: TemporalSemanticsSpec
    positional: bool
    metadata: dict[str, object] = field(default_factory=dict)

    @property
    def segments(self) -> tuple[str, ...]:
        return tuple(self.bounds)

    def condition(self, name: str, frame: DataFrame | None = None):
        low, high = self.bounds[name]
        frame = self.frame if frame is None else frame
        if self.positional:
            return (F.col(POSITION) >= low) & (F.col(POSITION) < high)
        return between(as_time(frame, self.semantics.column_for_segment(name)), low, high)

    def segment(self, name: str) -> DataFrame:
        """The rows of a segment."""
        if name not in self.bounds:
            raise KeyError(name)
        return self.frame.where(self.condition(name)).drop(POSITION)

    def slice(self, frame: DataFrame | None = None) -> dict[str, DataFrame]:
        if frame is None or frame is self.frame:
            return {n: self.segment(n) for n in self.bounds}
        if self.positional and POSITION not in frame.columns:
            raise ValueError("a fold by position slices the frame that it was planned on")
        return {n: frame.where(self.condition(n, frame)) for n in self.bounds}

    def slice_xy(self, y: DataFrame, key: str) -> dict[str, tuple[DataFrame, DataFrame]]:
        """Each segment's rows, and those of y with the same key."""
        return {n: (x, y.join(x.select(key), key, "left_semi")) for n, x in self.slice().items()}

    def summary(self) -> dict[str, object]:
        out: dict[str, object] = {"fold": self.fold}
        for n, b in self.boundaries.items():
            out |= {f"{n}_start": b.start, f"{n}_end": b.end, f"{n}_rows": self.counts[n]}
        return out | self.metadata

    def feature_history_bounds(self, lookbacks: FeatureLookbackSpec, segment_name: str = "train") -> dict[str, SegmentBoundaries]:
        """For each feature group, the time before the segment's start that its history reaches over."""
        anchor = instant_us(self.boundaries[segment_name].start)
        return {g: SegmentBoundaries(instant(anchor - d), instant(anchor)) for g, d in lookbacks.durations().items()}

    def slice_feature_history(self, lookbacks: FeatureLookbackSpec, time_col=None, segment_name: str = "train") -> dict[str, DataFrame]:
        time = as_time(self.frame, self.semantics.timeline_col if time_col is None else time_col)
        return {g: self.frame.where(between(time, instant_us(b.start), instant_us(b.end))) for g, b in self.feature_history_bounds(lookbacks, segment_name).items()}


class TimeIndexer:
    """A table by time: its span, and its rows by place or between times. Nothing but single values comes to the driver."""

    def __init__(self, X, time_col, keys: Sequence[str] = ()):
        self.frame, self.semantics, self.keys = coerce_tabular_input(X), TemporalSemanticsSpec.of(time_col), list(keys)
        self._time = as_time(self.frame, self.semantics.timeline_col)
        span = self.frame.select(us(self._time).alias("t")).agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count(F.lit(1)).alias("n")).first()
        self.total_rows, self.min_time, self.max_time = span["n"], *(None if t is None else instant(t) for t in (span["low"], span["high"]))

    def slice_positional(self, start: int, end: int) -> DataFrame:
        """Rows start to end in the order of the order column."""
        placed = with_position(self.frame, as_time(self.frame, self.semantics.effective_order_col), self.keys)
        return placed.where((F.col(POSITION) >= start) & (F.col(POSITION) < end)).drop(POSITION)

    def timestamp_at(self, position: int):
        """The time of the row at a place of the timeline; negative places count from the end."""
        place = position + self.total_rows if position < 0 else position
        if not 0 <= place < self.total_rows:
            raise IndexError(f"no row at {position}")
        found = with_position(self.frame, self._time, self.keys).where(F.col(POSITION) == place).select(us(self._time).alias("t")).first()["t"]
        return None if found is None else instant(found)

    def bounds_between(self, start, end) -> tuple[int, int]:
        """How many rows of the timeline lie before start, and before end."""
        row = self.frame.agg(*(F.count(F.when(self._time < at(instant_us(t)), 1)).alias(n) for n, t in (("a", start), ("b", end)))).first()
        return row["a"], row["b"]

    def slice_between(self, start, end, segment: str | None = None) -> DataFrame:
        """Rows from start on and before end, by the timeline or by the time column of a segment."""
        time = self._time if segment is None else as_time(self.frame, self.semantics.column_for_segment(segment))
        return self.frame.where(between(time, instant_us(start), instant_us(end)))


class TemporalBacktestSplitter:
    """Lays folds of a partition over a time column."""

    def __init__(self, *, time_col, partition: TemporalPartitionSpec, step=None, strategy: str = "rolling", allow_partial: bool = False, engine: str = "auto", keys: Sequence[str] = ()):
        self.semantics = TemporalSemanticsSpec.of(time_col)
        self.partition = validate_partition_spec(partition)
        self.strategy = validate_strategy(strategy)
        if step is None:
            step = next(iter(self.partition.segments.values())) if strategy == "single" else partition.test_size
        self.step = validate_step(step, self.partition.size_kind)
        validate_temporal_semantics(self.semantics, self.partition.size_kind)
        if engine not in ENGINES:
            raise ValueError(f"engine must be one of {', '.join(ENGINES)}")
        self.allow_partial, self.engine, self.keys = allow_partial, engine, list(keys)

    def _bound(self, X) -> DataFrame:
        df = coerce_tabular_input(X)
        resolve(df, self.semantics.timeline_col)
        resolve(df, self.semantics.effective_order_col)
        for ref in self.semantics.segment_time_cols.values():
            resolve(df, ref)
        return df

    def plan(self, X, title: str | None = None, most: int | None = None, metadata: PartitionEngineMetadata | None = None) -> PartitionPlan:
        """All folds with their row counts: one job for the span, one for a histogram of each time column. metadata: what X was before, if it has been converted already."""
        if metadata is None:
            found = PartitionEngine.from_input(X, self.engine)
            X, metadata = found.data, found.metadata
        plan = self._plan(self._bound(X), title, most, metadata)
        if not plan.folds:
            raise ValueError("the partition has no fold on this table")
        return plan

    def _plan(self, df: DataFrame, title: str | None = None, most: int | None = None, metadata: PartitionEngineMetadata = PartitionEngineMetadata("spark", "spark", False)) -> PartitionPlan:
        time = as_time(df, self.semantics.timeline_col)
        span = df.select(us(time).alias("t")).agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count(F.lit(1)).alias("n")).first()
        if not span["n"]:
            raise ValueError("the table is empty")
        frame, kind = df, self.partition.size_kind
        if span["low"] is None:
            folds: list[PlannedFold] = []
        elif kind == "duration":
            folds = self._duration_folds(df, span["low"], span["high"], most)
        else:
            order = as_time(df, self.semantics.effective_order_col)
            frame = with_position(df, order, self.keys)
            folds = self._row_folds(df, frame, span["n"], most)

        def split_of(f: PlannedFold) -> TimeSplit:
            return TimeSplit(f.iteration, frame, f.boundaries, f.bounds, f.counts, self.semantics, kind != "duration", dict(f.metadata))

        def summary_of(chosen, name):
            return SimulationResult(build_summary(chosen, span, self, name), [split_of(f) for f in chosen], metadata, chosen, plan)

        plan = PartitionPlan(df.sparkSession, tuple(folds), tuple(self.partition.segments), kind, self.strategy, split_of, summary_of, title)
        return plan

    def _duration_folds(self, df: DataFrame, low: int, high: int, most: int | None) -> list[PlannedFold]:
        spec, step = self.partition, self.step.value
        windows = list(duration_windows(spec, step, self.strategy, low, high, self.allow_partial, most))
        if not windows:
            return []
        start = low if spec.calendar is None else low // spec.calendar * spec.calendar
        width = common_step([step, spec.tail(), *(spec.gap(s) for s in spec.segments), *(spec.size(s) for s in spec.segments)])
        counts: dict[str, list[int]] = {}
        for ref in {self.semantics.column_for_segment(s) for s in spec.segments}:
            names = [s for s in spec.segments if self.semantics.column_for_segment(s) == ref]
            own_low, own_high = low, high
            time = as_time(df, ref)
            if ref != self.semantics.timeline_col:
                own = df.select(us(time).alias("t")).agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
                own_low, own_high = own["low"], own["high"]
                if own_low is None:
                    return []
            # Only rows that a window can hold are read; the bounds reach the scan.
            reach = df.where(between(time, min(w.start for w in windows), max(w.end for w in windows)))
            histogram = Histogram(reach, time, start, width, own_low, own_high)
            for s in names:
                counts[s] = histogram.counts([w.bounds[s] for w in windows])
        out = []
        for i, w in enumerate(windows):
            n = {s: counts[s][i] for s in spec.segments}
            if 0 in n.values():
                break
            out.append(PlannedFold(w.fold, {s: SegmentBoundaries(instant(a), instant(b)) for s, (a, b) in w.bounds.items()}, n, w.bounds, {"is_partial": w.is_partial}))
        return out

    def _row_folds(self, df: DataFrame, frame: DataFrame, total: int, most: int | None) -> list[PlannedFold]:
        windows = list(row_windows(self.partition, self.step, self.strategy, total, self.allow_partial, most))
        if not windows:
            return []
        wanted = sorted({p for w in windows for a, b in w.bounds.values() for p in (min(a, total - 1), min(b - 1, total - 1))})
        ranked = frame
        if self.semantics.effective_order_col != self.semantics.timeline_col:  # boundaries come from the timeline's own order
            ranked = with_position(df, as_time(df, self.semantics.timeline_col), self.keys)
        time = us(as_time(df, self.semantics.timeline_col)).alias("t")
        places = df.sparkSession.createDataFrame([(p,) for p in wanted], f"{POSITION} long")  # two for each segment and fold
        when = {r[POSITION]: r["t"] for r in ranked.select(POSITION, time).join(F.broadcast(places), POSITION, "left_semi").collect()}
        last = max((t for t in when.values() if t is not None), default=0)

        def bound(a: int, b: int) -> SegmentBoundaries:
            ends = [when.get(min(p, total - 1)) for p in (a, b - 1)]
            return SegmentBoundaries(*(instant(last if t is None else t) for t in ends))

        return [PlannedFold(w.fold, {s: bound(*b) for s, b in w.bounds.items()}, {s: b - a for s, (a, b) in w.bounds.items()}, w.bounds, {"is_partial": w.is_partial}) for w in windows]

    def iter_splits(self, X) -> Iterator[TimeSplit]:
        yield from self._plan(self._bound(X)).iter_splits()

    def split(self, X, y=None, groups=None) -> Iterator[tuple[DataFrame, ...]]:
        """The segments of each fold, in order, as DataFrames."""
        for s in self.iter_splits(X):
            yield tuple(s.slice().values())

    def get_n_splits(self, X=None, y=None, groups=None) -> int:
        if X is None:
            raise ValueError("the number of folds depends on the table")
        return len(self._plan(self._bound(X)))

    def describe_simulation(self, X, title: str | None = None, output: str = "summary") -> SimulationSummary | SimulationChartData:
        if output not in ("summary", "chart_data"):
            raise ValueError("output is summary or chart_data")
        result = self.plan(X, title).materialize()
        return result.summary if output == "summary" else result.chart_data

    def membership(self, X, keys: Sequence[str]) -> DataFrame:
        """fold, segment and the keys of every row of every fold: windows meet rows by arithmetic on the fold number, without a join."""
        plan = self.plan(X)
        return membership(plan, keys)


#: Rows of the table by which values meet windows.
MOST_MEETINGS = 200_000


def meet(rows: DataFrame, at: str, windows: Sequence[tuple[int, int, int]], name: str) -> DataFrame:
    """A row for each window (number, from, to) that a row's value `at` lies in, with the number as `name`.

    Windows are listed by the cells of a grid that they reach into, so a row is joined by its cell to the windows there and compared with no others.
    """
    windows = [w for w in windows if w[2] > w[1]]
    if not windows:
        return rows.where(F.lit(False)).withColumn(name, F.lit(None).cast("int"))
    low = min(a for _, a, _ in windows)
    grid = max(min(b - a for _, a, b in windows), sum(b - a for _, a, b in windows) // MOST_MEETINGS, 1)
    table = [(c, w, a, b) for w, a, b in windows for c in range((a - low) // grid, (b - 1 - low) // grid + 1)]
    cells = rows.sparkSession.createDataFrame(table, f"_cf_grid long, `{name}` int, _cf_low long, _cf_high long")  # MOST_MEETINGS rows and two for each window at most
    value = F.col(at) - F.lit(low)
    placed = rows.withColumn("_cf_grid", F.expr(f"(`{at}` - {low}L - pmod(`{at}` - {low}L, {grid}L)) div {grid}L")).where(value >= 0)
    return placed.join(F.broadcast(cells), "_cf_grid").where((F.col(at) >= F.col("_cf_low")) & (F.col(at) < F.col("_cf_high"))).drop("_cf_grid", "_cf_low", "_cf_high")


def membership(plan: PartitionPlan, keys: Sequence[str], fold: str = "fold", segment: str = "segment", frame: DataFrame | None = None) -> DataFrame:
    """fold, segment, keys. A row's folds are a run of numbers where windows roll; each is tried against its own bounds.

    fold and segment name those two columns, which no key may be called. frame: the planned table with more columns.
    """
    if {fold.lower(), segment.lower()} & {k.lower() for k in keys}:
        raise ValueError(f"a key is called {fold} or {segment}: give other names for these")
    split = plan.split_of(plan.folds[0])
    frame = split.frame if frame is None else frame
    parts = []
    for name in plan.segments:
        value = F.col(POSITION) if split.positional else us(as_time(frame, split.semantics.column_for_segment(name)))
        lows, highs = [f.bounds[name][0] for f in plan.folds], [f.bounds[name][1] for f in plan.folds]
        ids = [f.iteration for f in plan.folds]
        rows = frame.select(*[named(k) for k in keys], value.alias("_cf_at"))
        rows = rows.where((F.col("_cf_at") >= min(lows)) & (F.col("_cf_at") < max(highs)))
        stride = lows[1] - lows[0] if len(lows) > 1 else 0
        even = stride > 0 and all(b - a == stride for a, b in zip(lows, lows[1:])) and all(h - l == highs[0] - lows[0] for l, h in zip(lows, highs)) and ids == list(range(ids[0], ids[0] + len(ids)))
        if even:
            first = F.greatest(F.lit(ids[0]), F.expr(f"({ids[0]} + ((_cf_at - {highs[0]}) - pmod(_cf_at - {highs[0]}, {stride}L)) div {stride}L + 1)"))
            last = F.least(F.lit(ids[-1]), F.expr(f"({ids[0]} + (_cf_at - {lows[0]}) div {stride}L)"))
            rows = rows.withColumn(fold, F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))))
        else:
            rows = meet(rows, "_cf_at", list(zip(ids, lows, highs)), fold)
        parts.append(rows.select(named(fold), F.lit(name).alias(segment), *[named(k) for k in keys]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class SimulationResult:
    summary: SimulationSummary
    splits: list[TimeSplit]
    engine_metadata: PartitionEngineMetadata
    folds: Sequence[PlannedFold]
    plan: PartitionPlan

    @property
    def total_folds(self) -> int:
        return len(self.splits)

    @property
    def chart_data(self) -> SimulationChartData:
        return self.summary.chart_data

    def to_frame(self) -> DataFrame:
        return self.plan.to_frame().where(F.col("iteration").isin([f.iteration for f in self.folds])).drop("iteration", "is_partial")

    def to_dict(self) -> dict[str, object]:
        return self.summary.to_dict()

    def iter_splits(self) -> Iterator[TimeSplit]:
        return iter(self.splits)


class TemporalSimulation:
    """A splitter with bounds on the timeline (both inclusive) and on the number of folds."""

    def __init__(self, *, time_col, partition: TemporalPartitionSpec, step=None, strategy: str = "rolling", allow_partial: bool = False, engine: str = "auto", start_at=None, end_at=None, max_folds: int | None = None, keys: Sequence[str] = ()):
        if max_folds is not None and max_folds <= 0:
            raise ValueError("max_folds must be positive")
        self.splitter = TemporalBacktestSplitter(time_col=time_col, partition=partition, step=step, strategy=strategy, allow_partial=allow_partial, engine=engine, keys=keys)
        self.start_at, self.end_at, self.max_folds = start_at, end_at, max_folds
        if start_at is not None and end_at is not None and instant_us(end_at) < instant_us(start_at):
            raise ValueError("end_at is before start_at")

    @property
    def time_col(self):
        return self.splitter.semantics.timeline_col

    @property
    def semantics(self) -> TemporalSemanticsSpec:
        return self.splitter.semantics

    def as_splitter(self) -> TemporalBacktestSplitter:
        return self.splitter

    def select_input(self, X) -> DataFrame:
        df = self.splitter._bound(X)
        time = as_time(df, self.time_col)
        if self.start_at is not None:
            df = df.where(time >= at(instant_us(self.start_at)))
        if self.end_at is not None:
            df = df.where(time <= at(instant_us(self.end_at)))
        return df

    def plan(self, X, title: str | None = None) -> PartitionPlan:
        found = PartitionEngine.from_input(X, self.splitter.engine)
        return self.splitter.plan(self.select_input(found.data), title, self.max_folds, found.metadata)

    def run(self, X, title: str | None = None) -> SimulationResult:
        return self.plan(X, title).materialize()

    def iter_splits(self, X) -> Iterator[TimeSplit]:
        return self.plan(X).iter_splits()


class WalkForwardPolicy(TemporalSimulation):
    """A simulation under the name of the question it answers."""

    @property
    def simulation(self) -> TemporalSimulation:
        return self


@dataclass(frozen=True)
class SimulationVariant:
    name: str
    simulation: TemporalSimulation
    title: str | None = None
    metadata: dict[str, object] = field(default_factory=dict)


CAMPAIGN = "variant string, title string, total_folds int, total_rows long, dataset_start timestamp_ntz, dataset_end timestamp_ntz, time_col string, strategy string, size_kind string, segment_order array<string>, engine map<string,string>, metadata map<string,string>"


@dataclass(frozen=True)
class BatchSimulationResult:
    variants: list[SimulationVariant]
    results: list[SimulationResult]
    max_workers: int | None = None

    def result_for(self, name: str) -> SimulationResult:
        for v, r in zip(self.variants, self.results):
            if v.name == name:
                return r
        raise KeyError(name)

    def to_frame(self) -> DataFrame:
        rows = []
        for v, r in zip(self.variants, self.results):
            s = r.summary
            engine = {k: str(x) for k, x in vars(r.engine_metadata).items()}
            rows.append((v.name, v.title or v.name, s.total_folds, s.total_rows, s.dataset_start, s.dataset_end, str(s.time_col), s.strategy, s.size_kind, list(s.segment_order), engine, {k: str(x) for k, x in v.metadata.items()}))
        return self.results[0].plan.spark.createDataFrame(rows, CAMPAIGN)

    def to_dict(self) -> dict[str, object]:
        return {v.name: r.to_dict() for v, r in zip(self.variants, self.results)}


class SimulationCampaign:
    """Several simulations of one table; their jobs may run at the same time."""

    def __init__(self, variants: Sequence[SimulationVariant]):
        if not variants:
            raise ValueError("a campaign needs variants")
        if len({v.name for v in variants}) < len(variants):
            raise ValueError("names of variants must differ")
        self.variants = list(variants)

    def run(self, frame, max_workers: int | None = None) -> BatchSimulationResult:
        if max_workers is not None and max_workers <= 0:
            raise ValueError("max_workers must be positive")
        df = coerce_tabular_input(frame)
        one = lambda v: v.simulation.run(df, v.title or v.name)
        if (max_workers or 1) > 1:
            with ThreadPoolExecutor(max_workers) as pool:
                results = list(pool.map(one, self.variants))
        else:
            results = [one(v) for v in self.variants]
        return BatchSimulationResult(self.variants, results, max_workers)
