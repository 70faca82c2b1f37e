import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def daily(spark):
    """Rows a day apart from 2024-01-01: row_id, timestamp, feature 0.., target 100.."""
    from pyspark.sql import functions as F

    def make(n: int, start: str = "2024-01-01", target: str = "row_id + 100"):
        return spark.range(n).select(F.col("id").alias("row_id"), F.expr(f"timestamp_ntz'{start}' + make_interval(0, 0, 0, int(id))").alias("timestamp"), F.col("id").alias("feature"), F.expr(target.replace("row_id", "id")).alias("target"))

    return make
