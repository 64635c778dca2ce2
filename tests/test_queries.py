"""Every registered query with SQL against DuckDB, at the smallest scale."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from wayloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "orders", "customer"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    def show(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    mine, sql = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(sql.columns)
    assert rows(mine) == rows(sql)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_trip_lengths_count_steps_only(spark):
    """The first point of a trip has no step: points lie within 25 km of one another."""
    t = registry.queries()["trip_gap_sessions"](spark, SF).selectExpr("max(length_km / (n_points - 1)) as far").first()
    assert t.far < 25
