"""Queries of this subpackage that have SQL equal DuckDB on whole tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from cadenza.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got)
    got, want = (d[cols].sort_values(cols, ignore_index=True) for d in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
