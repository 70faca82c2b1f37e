"""Prequential evaluation of a running mean over a stream: windows closed by the watermark are batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_sums(stream: DataFrame, time_col: str, target_col: str, size: str, late: str) -> DataFrame:
    """window_start, rows, total, squares of each tumbling window; rows later than the watermark are left out."""
    y = F.col(target_col).cast("double")
    at = F.col(time_col).cast("timestamp")
    return (
        stream.select(at.alias("t"), y.alias("y"))
        .withWatermark("t", late)
        .groupBy(F.window("t", size).alias("w"))
        .agg(F.count("y").alias("rows"), F.sum("y").alias("total"), F.sum(F.col("y") * F.col("y")).alias("squares"))
        .select(F.col("w.start").alias("window_start"), "rows", "total", "squares")
    )


def prequential_mse(sums: DataFrame) -> DataFrame:
    """window_start, rows, prediction, mse of each window but the first, where the mean of all earlier windows predicts it. A table has a row for each window."""
    from pyspark.sql import Window

    before = Window.orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    p = F.sum("total").over(before) / F.sum("rows").over(before)
    mse = (F.col("squares") - 2 * F.col("p") * F.col("total") + F.col("rows") * F.col("p") * F.col("p")) / F.col("rows")
    return sums.withColumn("p", p).where("p is not null").select("window_start", "rows", F.col("p").alias("prediction"), mse.alias("mse"))


def sessions(stream: DataFrame, time_col: str, key_col: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key: runs of rows with no longer pause than the gap."""
    return stream.withColumn("t", F.col(time_col).cast("timestamp")).withWatermark("t", late).groupBy(key_col, F.session_window("t", gap).alias("s")).agg(F.count(F.lit(1)).alias("rows")).select(key_col, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "rows")
