"""Tables of other libraries as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class PartitionEngineMetadata:
    engine: str
    input_backend: str
    converted: bool

    def to_dict(self) -> dict[str, object]:
        return {"engine": self.engine, "input_backend": self.input_backend, "converted": self.converted}


def detect_backend(X) -> str:
    if isinstance(X, DataFrame):
        return "spark"
    if isinstance(X, pd.DataFrame):
        return "pandas"
    if isinstance(X, np.ndarray):
        return "numpy"
    if isinstance(X, pa.Table):
        return "arrow"
    if type(X).__module__.split(".")[0] == "polars":
        return "polars"
    raise TypeError(f"not a table: {type(X).__name__}")


def coerce_tabular_input(X) -> DataFrame:
    """A Spark DataFrame as it is; pandas, Arrow, polars and NumPy (structured, or with one or two dimensions) are converted."""
    kind = detect_backend(X)
    if kind == "spark":
        return X
    spark = SparkSession.builder.getOrCreate()
    if kind == "numpy":
        if X.ndim not in (1, 2):
            raise TypeError("an array needs one or two dimensions")
        X = pd.DataFrame(X) if X.dtype.names or X.ndim == 2 else pd.DataFrame({0: X})
        X.columns = [str(c) for c in X.columns]
    if kind == "polars":
        X = X.to_arrow()
    if isinstance(X, pd.DataFrame):
        X = pa.Table.from_pandas(X.rename(columns=str), preserve_index=False)
    return spark.createDataFrame(X)


#: Engines that may be asked for. Planning always runs on Spark; the others say which kinds of table are expected.
ENGINES = {"auto": None, "spark": None, "pandas": None, "polars": ("pandas", "polars"), "numpy": ("pandas", "numpy")}


@dataclass(frozen=True)
class PartitionEngine:
    """A table as a DataFrame, with what it was before."""

    data: DataFrame
    metadata: PartitionEngineMetadata

    @classmethod
    def from_input(cls, X, prefer: str = "auto") -> PartitionEngine:
        """Convert a table. An engine that only takes some kinds of table refuses the others."""
        if prefer not in ENGINES:
            raise ValueError(f"engine must be one of {', '.join(ENGINES)}")
        kind = detect_backend(X)
        if ENGINES[prefer] and kind not in ENGINES[prefer]:
            raise ValueError(f"the {prefer} engine takes {' and '.join(ENGINES[prefer])} tables, not {kind}")
        return cls(coerce_tabular_input(X), PartitionEngineMetadata("spark", kind, kind != "spark"))

    @property
    def columns(self) -> list[str]:
        return self.data.columns

    @property
    def total_rows(self) -> int:
        return self.data.count()

    @property
    def empty(self) -> bool:
        return self.data.isEmpty()


def missing_columns(columns, available) -> list:
    """Names that aren't available, and positions out of range."""
    names = list(available)
    return [c for c in columns if (not 0 <= c < len(names) if isinstance(c, int) else c not in names)]
