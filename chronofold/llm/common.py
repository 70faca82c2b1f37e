"""What the text operators share: the shared work folder, written tables, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 8 << 20

_written: list[tuple[SparkSession, str]] = []


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use yet, for rows that pass through an operator with all their columns."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master, where all run on one machine, gets a temporary folder if that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="chronofold-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; removed when Python ends."""
    path = f"{shared_folder(spark)}/chronofold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path that work_path gave and whose table is no longer read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def made_since() -> Iterator[list[str]]:
    """The paths that work_path gives meanwhile."""
    before, made = len(_written), []
    yield made
    made.extend(path for _, path in _written[before:])


def drop_made(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        drop_path(spark, path)


def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended already
            return


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows of df as a table in the shared folder: later steps don't compute them again, and a lost executor costs none."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.chronofold_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t.chronofold_path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: its cleaner waits until the driver's memory is collected."""
    spark.sparkContext._jvm.System.gc()


_stores: list = []


def stored(most: int) -> Callable:
    """lru_cache for what a Python worker keeps from task to task; drop_stores() empties it."""

    def wrap(f: Callable) -> Callable:
        _stores.append(lru_cache(most)(f))
        return _stores[-1]

    return wrap


def drop_stores() -> None:
    """Forget what earlier steps kept in this worker, where a step needs none of it."""
    for f in _stores:
        f.cache_clear()


def tidy() -> None:
    """Give memory that a Python worker has freed back to the system, so that it isn't held beside that of other workers."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound what Python workers get at once, however long texts are; a smaller bound that was set stays."""
    most = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if most is None or not most.isdigit() or not 0 < int(most) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """mapInArrow with a function that is made once for each task and yields dicts of columns for each batch."""
    kinds = spark_schema(df.sparkSession, schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        each = make()
        for batch in batches:
            for columns in each(batch):
                yield pa.RecordBatch.from_arrays([as_arrow(columns[f.name], f.type) for f in kinds], schema=kinds)
        tidy()

    return df.mapInArrow(run, schema)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def spark_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of rows that the driver has, as Arrow: rows of Python objects would be read by Python workers of a second kind, which stay beside the others."""
    kinds = spark_schema(spark, ddl)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator works on, as doc_id long and text string; other columns, whatever their names, are left.

    Ids are whole numbers or text that reads as one; another id is an error of the cast, so that no two documents become one.
    """
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
