"""Registered queries against their SQL on small tables, where those are there."""

import glob
import os

import pytest

import __spark_entry__ as entry
from chronofold.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.01"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    plain = lambda v: v.as_unit("us").to_pydatetime() if hasattr(v, "to_pydatetime") else v.item() if hasattr(v, "item") else v
    rows = lambda pdf: sorted(str([plain(v) for v in r]) for r in pdf[columns].astype(object).itertuples(index=False, name=None))
    assert rows(found.toPandas()) == rows(con.execute(SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
