"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lightbox.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def cells(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
            return "~"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    mine, other = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert cells(mine) == cells(other)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
