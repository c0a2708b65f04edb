"""Every query against its SQL at sf0.001, and the driver contract."""

import glob
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from locusframe.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    cols = sorted(df.columns)
    out = []
    for r in df[cols].itertuples(index=False, name=None):
        out.append(repr([None if pd.isna(x) else f"{float(x):.5f}" if isinstance(x, numbers.Number) and not isinstance(x, (bool, np.bool_)) else str(x) for x in r]))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    want = db.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    """Only what no SQL expresses: k-means, which tests/test_whole.py holds against separable data."""
    assert name == "peak_clusters"
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_contract(spark):
    assert entry_module.entry(spark).count() == 1
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
