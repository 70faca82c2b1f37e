"""Fold geometry by closed forms: which windows a partition lays over a timeline. No Spark here."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from chronofold.plans.spec import SizeSpec, ValidatedPartitionSpec


@dataclass(frozen=True)
class Window:
    """Half-open bounds of each segment: microseconds, or positions."""

    fold: int
    bounds: dict[str, tuple[int, int]]
    is_partial: bool

    @property
    def start(self) -> int:
        return min(b[0] for b in self.bounds.values())

    @property
    def end(self) -> int:
        return max(b[1] for b in self.bounds.values())


def _laid_out(spec: ValidatedPartitionSpec, start: int, total: int) -> dict[str, tuple[int, int]]:
    out, at = {}, start
    for name in spec.segments:
        begin = at + spec.gap(name, total)
        at = begin + spec.size(name, total)
        out[name] = (begin, at)
    return out


def duration_windows(spec: ValidatedPartitionSpec, step: int, strategy: str, low: int, high: int, allow_partial: bool, most: int | None = None) -> Iterator[Window]:
    """Candidate folds between the least and the greatest time; the caller ends them at the first with an empty segment.

    A fold is whole if its last end, tail gap included, isn't after the greatest time. With allow_partial, later folds whose last segment starts before
    it are kept, cut to just behind the greatest time.
    """
    first = low if spec.calendar is None else low // spec.calendar * spec.calendar
    last = list(spec.segments)[-1]
    fold = 0
    while most is None or fold < most:
        at = first + fold * step
        bounds = _laid_out(spec, at, 0)
        if strategy == "expanding":
            begin = low + spec.gap("train")
            end = at + spec.size("train")
            bounds["train"] = (begin, end if end > begin else begin + spec.size("train"))
            shift = bounds["train"][1]
            for name in list(spec.segments)[1:]:
                start = shift + spec.gap(name)
                shift = start + spec.size(name)
                bounds[name] = (start, shift)
        start, end = bounds[last]
        partial = end + spec.tail() > high
        if partial:
            if not allow_partial or start >= high:
                return
            bounds[last] = (start, high + 1)
        yield Window(fold, bounds, partial)
        if strategy == "single":
            return
        fold += 1


def row_windows(spec: ValidatedPartitionSpec, step: SizeSpec, strategy: str, total: int, allow_partial: bool, most: int | None = None) -> Iterator[Window]:
    """Folds by position."""
    stride = step.rows(total)
    last = list(spec.segments)[-1]
    fold = 0
    while most is None or fold < most:
        bounds = _laid_out(spec, fold * stride, total)
        if strategy == "expanding":
            at = spec.size("train", total) + fold * stride
            bounds["train"] = (spec.gap("train", total), at)
            for name in list(spec.segments)[1:]:
                start = at + spec.gap(name, total)
                at = start + spec.size(name, total)
                bounds[name] = (start, at)
        start, end = bounds[last]
        partial = end + spec.tail(total) > total
        if partial:
            if not allow_partial or start >= total:
                return
            bounds[last] = (start, total)
        if any(b <= a for a, b in bounds.values()):
            return
        yield Window(fold, bounds, partial)
        if strategy == "single":
            return
        fold += 1
