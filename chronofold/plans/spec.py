"""Sizes, partitions and time semantics: plain configuration on the driver."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import gcd

import pandas as pd

LAYOUTS = {"train_test": ("train", "test"), "train_val_test": ("train", "validation", "test")}
STRATEGIES = ("single", "rolling", "expanding")
SEGMENTS = ("train", "validation", "test")


def duration_us(value) -> int:
    """Microseconds of a duration: timedelta or text with a unit ("30D", "12h", "1W", "90min", "P1D"). A text without a unit is an error."""
    if isinstance(value, str) and not re.search(r"[A-Za-z:]", value):
        raise ValueError(f"duration {value!r} has no unit")
    try:
        found = pd.Timedelta(value)
    except (ValueError, TypeError) as e:
        raise ValueError(f"not a duration: {value!r}") from e
    if found is pd.NaT:
        raise ValueError(f"not a duration: {value!r}")
    return int(found.value // 1000)


def instant_us(value) -> int:
    """Microseconds since 1970 of a point in time, without zone."""
    at = pd.Timestamp(value)
    if at.tzinfo is not None:
        at = at.tz_convert("UTC").tz_localize(None)
    return int(at.value // 1000)


def instant(us: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)


@dataclass(frozen=True)
class SizeSpec:
    """A size as a duration (microseconds), rows, or a fraction of all rows."""

    value: int | float
    kind: str

    @classmethod
    def from_value(cls, value) -> SizeSpec:
        if isinstance(value, SizeSpec):
            return value
        if isinstance(value, bool):
            raise TypeError("a size is a duration, a number of rows or a fraction, not a bool")
        if isinstance(value, int):
            if value <= 0:
                raise ValueError("a number of rows must be positive")
            return cls(value, "rows")
        if isinstance(value, float):
            if not 0 < value < 1:
                raise ValueError("a fraction lies between 0 and 1")
            return cls(value, "fraction")
        if isinstance(value, str | dt.timedelta | pd.Timedelta):
            return cls(duration_us(value), "duration")
        raise TypeError(f"not a size: {value!r}")

    def rows(self, total: int) -> int:
        """Rows of a positional size; fractions are rounded half to even, and none may become 0."""
        n = self.value if self.kind == "rows" else int(round(total * self.value))
        if n <= 0:
            raise ValueError("a fraction of this table has no rows")
        return n

    def __str__(self) -> str:
        return str(pd.Timedelta(self.value, "us")) if self.kind == "duration" else str(self.value)


@dataclass(frozen=True)
class TemporalPartitionSpec:
    layout: str = "train_test"
    train_size: object = None
    test_size: object = None
    validation_size: object = None
    gap_before_train: object = None
    gap_before_validation: object = None
    gap_before_test: object = None
    gap_after_test: object = None
    calendar_frequency: str | None = None


@dataclass(frozen=True)
class TemporalSemanticsSpec:
    """Which column is the timeline, which orders rows, and which says when a row is available to a segment."""

    timeline_col: str | int
    order_col: str | int | None = None
    segment_time_cols: Mapping[str, str | int] = field(default_factory=dict)

    @classmethod
    def of(cls, value) -> TemporalSemanticsSpec:
        return value if isinstance(value, TemporalSemanticsSpec) else cls(value)

    @property
    def effective_order_col(self):
        return self.timeline_col if self.order_col is None else self.order_col

    def column_for_segment(self, segment: str):
        return self.segment_time_cols.get(segment, self.timeline_col)


@dataclass(frozen=True)
class FeatureLookbackSpec:
    """How far back the history of feature groups reaches."""

    default_lookback: object = None
    group_lookbacks: Mapping[str, object] = field(default_factory=dict)
    feature_groups: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def durations(self) -> dict[str, int]:
        out = {} if self.default_lookback is None else {"__default__": self._us(self.default_lookback)}
        return out | {g: self._us(v) for g, v in self.group_lookbacks.items()}

    @staticmethod
    def _us(value) -> int:
        size = SizeSpec.from_value(value)
        if size.kind != "duration" or size.value <= 0:
            raise ValueError("a lookback is a positive duration")
        return size.value


@dataclass(frozen=True)
class SegmentBoundaries:
    start: dt.datetime
    end: dt.datetime


@dataclass(frozen=True)
class ValidatedPartitionSpec:
    segments: dict[str, SizeSpec]
    gaps: dict[str, SizeSpec | None]
    tail_gap: SizeSpec | None
    size_kind: str
    calendar: int | None

    def gap(self, segment: str, total: int = 0) -> int:
        g = self.gaps.get(segment)
        return 0 if g is None else g.value if g.kind == "duration" else g.rows(total)

    def size(self, segment: str, total: int = 0) -> int:
        s = self.segments[segment]
        return s.value if s.kind == "duration" else s.rows(total)

    def tail(self, total: int = 0) -> int:
        g = self.tail_gap
        return 0 if g is None else g.value if g.kind == "duration" else g.rows(total)


def calendar_us(frequency: str | None) -> int | None:
    """Microseconds of a fixed frequency; months, weeks with an anchor and the like aren't fixed."""
    if frequency is None:
        return None
    try:
        offset = pd.tseries.frequencies.to_offset(frequency)
        return int(pd.Timedelta(offset).value // 1000)
    except (ValueError, TypeError) as e:
        raise ValueError(f"calendar_frequency must be fixed: {frequency!r}") from e


def validate_strategy(strategy: str) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    return strategy


def validate_partition_spec(spec: TemporalPartitionSpec) -> ValidatedPartitionSpec:
    if spec.layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {', '.join(LAYOUTS)}")
    names = LAYOUTS[spec.layout]
    if "validation" not in names and (spec.validation_size is not None or spec.gap_before_validation is not None):
        raise ValueError("validation sizes need the layout train_val_test")
    missing = [n for n in names if getattr(spec, f"{n}_size") is None]
    if missing:
        raise ValueError(f"{missing[0]}_size is missing")
    segments = {n: SizeSpec.from_value(getattr(spec, f"{n}_size")) for n in names}
    gaps = {n: None if getattr(spec, f"gap_before_{n}") is None else SizeSpec.from_value(getattr(spec, f"gap_before_{n}")) for n in names}
    tail = None if spec.gap_after_test is None else SizeSpec.from_value(spec.gap_after_test)
    kinds = {s.kind for s in [*segments.values(), *gaps.values(), tail] if s is not None}
    if len(kinds) > 1:
        raise ValueError("sizes and gaps must all be durations, all rows or all fractions")
    kind = kinds.pop()
    if kind == "duration" and any(s.value <= 0 for s in segments.values()):
        raise ValueError("segment durations must be positive")
    calendar = calendar_us(spec.calendar_frequency)
    if calendar is not None and kind != "duration":
        raise ValueError("calendar_frequency needs durations")
    return ValidatedPartitionSpec(segments, gaps, tail, kind, calendar)


def validate_step(step, kind: str) -> SizeSpec:
    size = SizeSpec.from_value(step)
    if size.kind != kind:
        raise ValueError("step must be of the same kind as the sizes")
    if size.value <= 0:
        raise ValueError("step must be positive")
    return size


def validate_temporal_semantics(semantics: TemporalSemanticsSpec, kind: str) -> None:
    unknown = set(semantics.segment_time_cols) - set(SEGMENTS)
    if unknown:
        raise ValueError(f"unknown segment {sorted(unknown)[0]!r}")
    if semantics.segment_time_cols and kind != "duration":
        raise ValueError("time columns for segments need durations")


def common_step(values: Sequence[int]) -> int:
    out = 0
    for v in values:
        out = gcd(out, abs(v))
    return out or 1
