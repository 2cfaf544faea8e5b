"""Every query with SQL gives the rows that DuckDB gives on the same small tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from meterlake.plans import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_against_sql(spark, duck, name):
    got, want = all_queries()[name](spark, SF).toPandas(), duck.sql(all_oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_others_give_rows(spark, name):
    assert all_queries()[name](spark, SF).count() > 0


def test_p_values_are_those_of_their_statistics(spark):
    for name in ("correlation_pvalues", "period_significance"):
        for r in all_queries()[name](spark, SF).collect():
            df, t = (r.n - 2, r.headline * ((r.n - 2) / max(1 - r.headline**2, 1e-300)) ** 0.5) if name == "correlation_pvalues" else (r.df, r.t)
            if df > 0 and r.p_value is not None:
                assert r.p_value == pytest.approx(tail(t, df), abs=1e-4)


def tail(t: float, df: int, steps: int = 400_001) -> float:
    """Both tails of Student's t by the trapezoid rule over the angle whose tangent is t over the root of df."""
    theta = np.linspace(-np.pi / 2, np.pi / 2, steps)
    density = np.cos(theta) ** (df - 1)
    inside = np.abs(theta) <= np.arctan(abs(t) / df**0.5)
    return 1 - float(density[inside].sum() / density.sum())
