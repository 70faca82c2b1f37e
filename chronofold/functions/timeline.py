"""Time columns as microseconds, column references and exact row positions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.plans.spec import instant

#: The column that holds a row's place in a plan by position.
POSITION = "_cf_position"
#: Cells of time in which rows are numbered: at least and at most so many, one for each RANGE_ROWS rows between.
LEAST_CELLS, MOST_CELLS, RANGE_ROWS = 16, 1 << 19, 1_000_000


def resolve(df: DataFrame, ref: str | int) -> str:
    """The name of a column given by name or position."""
    if isinstance(ref, bool) or not isinstance(ref, str | int):
        raise TypeError(f"not a column: {ref!r}")
    if isinstance(ref, int):
        if not 0 <= ref < len(df.columns):
            raise ValueError(f"no column at position {ref}")
        return df.columns[ref]
    if ref not in df.columns:
        raise ValueError(f"no column {ref!r}")
    return ref


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_time(df: DataFrame, ref: str | int) -> Column:
    """A column as a timestamp without zone; texts are parsed, whole numbers are nanoseconds since 1970."""
    name = resolve(df, ref)
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return named(name)
    if isinstance(kind, T.TimestampType | T.DateType):
        return named(name).cast("timestamp_ntz")
    if isinstance(kind, T.StringType):
        return F.to_timestamp_ntz(named(name))
    if isinstance(kind, T.IntegralType):
        return F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (named(name) / 1e9).cast("decimal(18,6)"))
    raise TypeError(f"column {name!r} can't be a time: {kind.simpleString()}")


def us(time: Column) -> Column:
    """Microseconds since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time)


def at(micro: int) -> Column:
    """A point in time as a literal, so that comparisons with a raw column reach the scan."""
    return F.lit(instant(micro).isoformat(sep=" ")).cast("timestamp_ntz")


def between(time: Column, low: int, high: int) -> Column:
    return (time >= at(low)) & (time < at(high))


def with_position(df: DataFrame, order: Column, keys: list[str], name: str = POSITION) -> DataFrame:
    """df with each row's place (from 0) by time, nulls last, ties by the keys; without keys by all columns that can be sorted, so that only equal rows are tied.

    Rows are dealt into cells of time and numbered in each; the cells' sizes, which the driver adds up, give the offsets. Cells with many
    rows are cut again as long as they span more than an instant, so no task holds all rows, only those of one instant stay together. The
    place of a row is the same whenever it is computed.
    """
    keys = keys or [f.name for f in df.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    spark, t = df.sparkSession, F.col("_cf_order")
    marked = df.withColumn("_cf_order", us(order))
    span = marked.agg(F.min(t).alias("low"), F.max(t).alias("high"), F.count(F.lit(1)).alias("n")).first()
    low, high, n = span["low"] or 0, span["high"] or 0, span["n"]
    width = (high - low) // min(MOST_CELLS, max(LEAST_CELLS, n // RANGE_ROWS)) + 1
    # A cell is called by the time at which it starts; rows without a time have the last one.
    marked = marked.withColumn("_cf_cell", F.coalesce(t - F.pmod(t - F.lit(low), F.lit(width)), F.lit(high + 1)))
    sizes, widths, seen = {}, {}, marked
    while True:
        found = {r["_cf_cell"]: r["count"] for r in seen.groupBy("_cf_cell").count().collect()}
        sizes |= found
        large = {c: widths.get(c, width) for c, many in found.items() if many > 4 * RANGE_ROWS and c <= high and widths.get(c, width) > 1}
        if not large:
            break
        finer = {c: w // min(1024, 1 + sizes[c] // RANGE_ROWS) + 1 for c, w in large.items()}
        cut = F.broadcast(spark.createDataFrame(list(finer.items()), "_cf_cell long, _cf_width long"))  # n / RANGE_ROWS / 4 rows at most
        marked = marked.join(cut, "_cf_cell", "left").withColumn("_cf_cell", F.coalesce(t - F.pmod(t - F.col("_cf_cell"), F.col("_cf_width")), F.col("_cf_cell"))).drop("_cf_width")
        inside = [(t >= c) & (t < c + large[c]) for c in large]
        sizes = {c: m for c, m in sizes.items() if c not in large}
        condition = inside[0]
        for i in inside[1:]:
            condition = condition | i
        seen = marked.where(condition)
        widths |= {c + i * finer[c]: finer[c] for c, w in large.items() for i in range(-(-w // finer[c]))}
    total, offsets = 0, []
    for c in sorted(sizes):
        offsets.append((c, total))
        total += sizes[c]
    by = Window.partitionBy("_cf_cell").orderBy(t.asc_nulls_last(), *[named(k) for k in keys])
    table = spark.createDataFrame(offsets, "_cf_cell long, _cf_offset long")  # a row for each cell
    return marked.withColumn(name, F.row_number().over(by).cast("long") - 1).join(F.broadcast(table), "_cf_cell").withColumn(name, F.col(name) + F.col("_cf_offset")).select(*[named(c) for c in df.columns], name)


def table(spark, records) -> DataFrame:
    """Records that the driver holds, as a DataFrame; times are without zone."""
    blank = [c for c in records.columns if records[c].isna().all()]
    df = spark.createDataFrame(records.drop(columns=blank))
    kinds = {f.name: f.dataType for f in df.schema}
    cols = {n: named(n).cast("timestamp_ntz").alias(n) if isinstance(k, T.TimestampType) else named(n) for n, k in kinds.items()}
    empty = {c: F.lit(None).cast("double" if records[c].dtype.kind == "f" else "string").alias(c) for c in blank}
    return df.select(*[(cols | empty)[c] for c in records.columns])
