"""Every registered query with an oracle: Spark vs DuckDB on sf0.001 (row count, columns, values)."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from calibra.plans.catalog import REGISTRY

from .conftest import SF_SMALL

TABLES = ["lineitem", "part"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(6)
        df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTRY.items() if sql is not None))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(_norm(got), _norm(want))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns[:2] == ["model", "cls"]


def test_every_query_has_callable():
    assert set(E.oracle_sql()) <= set(E.queries())
