"""How many rows lie in each of many windows of time, by one histogram."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.timeline import us

#: Cells of a histogram that the driver takes; with more, the windows are joined to the rows' cells on the executors.
MOST_CELLS = 2_000_000


class Histogram:
    """Rows of one time column by cells of a grid: start + k * width. Answers windows whose bounds lie on the grid or outside the data."""

    def __init__(self, df: DataFrame, time: Column, start: int, width: int, low: int, high: int):
        self.start, self.width, self.low, self.high = start, width, low, high
        micro = us(time)
        self.rows = df.select(micro.alias("t")).where("t is not null")
        if high is not None and (high - start) // width <= MOST_CELLS:
            cell = F.expr(f"(t - {start} - pmod(t - {start}, {width}L)) div {width}L")
            found = sorted((r["c"], r["n"]) for r in self.rows.groupBy(cell.alias("c")).agg(F.count("*").alias("n")).collect())
            self.cells = [c for c, _ in found]
            self.sums = [0, *accumulate(n for _, n in found)]
        else:
            self.cells = None

    def before(self, bound: int) -> int | None:
        """Rows under a bound; None if it is inside the data and off the grid."""
        if self.cells is None:
            return None
        if bound <= self.low:
            return 0
        if bound > self.high:
            return self.sums[-1]
        if (bound - self.start) % self.width:
            return None
        return self.sums[bisect_left(self.cells, (bound - self.start) // self.width)]

    def counts(self, windows: list[tuple[int, int]]) -> list[int]:
        found = {b: self.before(b) for w in windows for b in w}
        unknown = sorted(b for b, n in found.items() if n is None)
        if unknown:
            found |= self._direct(unknown)
        return [max(found[b] - found[a], 0) for a, b in windows]

    def _direct(self, bounds: list[int]) -> dict[int, int]:
        """Rows under each of some bounds that aren't on the grid: each row finds its place among them by a binary search."""
        import numpy as np
        import pandas as pd

        edges = np.array(bounds)

        @F.pandas_udf("long")
        def place(t: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(edges, t.to_numpy(), "right"))

        n = {r["p"]: r["n"] for r in self.rows.groupBy(place("t").alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each bound at most
        sums = list(accumulate(n.get(i, 0) for i in range(len(bounds))))
        return dict(zip(bounds, sums))
