"""Summaries of simulations and the geometry of their timelines."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from chronofold.plans.spec import instant

#: The colours of the segments.
COLORS = {"train": "#1d4ed8", "validation": "#d97706", "test": "#059669"}
OTHER_COLOR = "#64748b"


@dataclass(frozen=True)
class SimulationChartData:
    segment_stats: dict[str, dict[str, object]]
    folds: list[dict[str, object]]
    simulation_span: tuple[dt.datetime, dt.datetime]

    def to_dict(self) -> dict[str, object]:
        return {"segment_stats": self.segment_stats, "folds": self.folds, "simulation_span": [x.isoformat() for x in self.simulation_span]}


@dataclass(frozen=True)
class SimulationSummary:
    title: str | None
    total_folds: int
    total_rows: int
    dataset_start: dt.datetime
    dataset_end: dt.datetime
    time_col: object
    strategy: str
    size_kind: str
    segment_order: tuple[str, ...]
    folds: list[dict[str, object]]
    chart_data: SimulationChartData

    def to_dict(self) -> dict[str, object]:
        return json_ready(vars(self) | {"chart_data": self.chart_data.to_dict()})


def json_ready(value):
    """Times as ISO text, durations as text, everything else as JSON knows it."""
    if isinstance(value, dict):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [json_ready(v) for v in value]
    if isinstance(value, dt.datetime | dt.date):
        return value.isoformat()
    if isinstance(value, dt.timedelta):
        return str(value)
    if hasattr(value, "item"):
        return value.item()
    return value


def build_summary(folds, span, splitter, title: str | None) -> SimulationSummary:
    names = tuple(splitter.partition.segments)
    rows = []
    for f in folds:
        row = f.to_dict()
        rows.append({k: v for k, v in row.items() if k not in ("iteration", "is_partial")})
    return SimulationSummary(title, len(folds), span["n"], instant(span["low"]), instant(span["high"]), splitter.semantics.timeline_col, splitter.strategy, splitter.partition.size_kind, names, rows, chart(folds, names))


def chart(folds, names) -> SimulationChartData:
    """Rows of each segment over the folds, and where each segment lies on the whole span in percent."""
    start, end = min(f.simulation_start for f in folds), max(f.simulation_end for f in folds)
    total = max((end - start).total_seconds(), 1)
    stats = {}
    for s in names:
        n = [f.counts[s] for f in folds]
        stats[s] = {"color": COLORS.get(s, OTHER_COLOR), "total_rows": sum(n), "avg_rows": sum(n) / len(n), "min_rows": min(n), "max_rows": max(n)}
    out = []
    for f in folds:
        parts = {}
        for s in names:
            b = f.boundaries[s]
            parts[s] = {
                "start": b.start, "end": b.end, "rows": f.counts[s], "color": COLORS.get(s, OTHER_COLOR),
                "offset_pct": round(max((b.start - start).total_seconds() / total * 100, 0), 4),
                "width_pct": round(max((b.end - b.start).total_seconds() / total * 100, 0.8), 4),
            }
        out.append({"fold": f.iteration, "segments": parts})
    return SimulationChartData(stats, out, (start, end))
