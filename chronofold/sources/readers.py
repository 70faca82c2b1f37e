"""Files as DataFrames: CSV, Parquet, and the first CSV of a ZIP archive."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {".csv": "csv", ".parquet": "parquet", ".zip": "zip"}


def resolve_format(path: str, dataset_format: str = "auto") -> str:
    if dataset_format != "auto":
        if dataset_format not in SUFFIXES.values():
            raise ValueError(f"format must be one of {', '.join(SUFFIXES.values())}")
        return dataset_format
    for suffix, kind in SUFFIXES.items():
        if path.rstrip("/").lower().endswith(suffix):
            return kind
    raise ValueError(f"the format of {path!r} isn't known by its suffix")


def load_dataset_frame(spark: SparkSession, path: str, dataset_format: str = "auto", sample_rows: int | None = None) -> DataFrame:
    """A file, or a folder of Parquet, in any store that Spark reads; an error if it is missing or has no rows."""
    kind = resolve_format(path, dataset_format)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "csv":
        df = spark.read.csv(path, header=True, inferSchema=True)
    else:
        df = _zipped(spark, path)
    df = df if sample_rows is None else df.limit(sample_rows)
    if df.isEmpty():
        raise ValueError(f"{path!r} has no rows")
    return df


def _zipped(spark: SparkSession, path: str) -> DataFrame:
    """The archive is opened by one worker, which yields lines; a ZIP cannot be split."""

    def lines(batches):
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                    if name is None:
                        raise ValueError("the archive has no CSV file")
                    import pandas as pd

                    with z.open(name) as f:
                        held: list[str] = []
                        for line in io.TextIOWrapper(f, "utf-8"):
                            held.append(line.rstrip("\r\n"))
                            if len(held) == 10_000:
                                yield pd.DataFrame({"value": held})
                                held = []
                        if held:
                            yield pd.DataFrame({"value": held})

    text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string")
    try:
        return spark.read.csv(text.rdd.map(lambda r: r["value"]), header=True, inferSchema=True)
    except Exception as e:
        if "no CSV file" in str(e):
            raise ValueError("the archive has no CSV file") from e
        raise


def preview_dataset(spark: SparkSession, path: str, sample_rows: int = 5, dataset_format: str = "auto") -> dict[str, object]:
    df = load_dataset_frame(spark, path, dataset_format, sample_rows)
    return {"path": path, "columns": df.columns, "rows": [r.asDict() for r in df.collect()]}


def head(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first rows by some keys."""
    return df.orderBy(*[F.col(k) for k in keys]).limit(n)
