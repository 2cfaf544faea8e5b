"""p-values of Student's t, and their correction for many tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _continued_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """The continued fraction of the incomplete beta function, evaluated from the front."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for m in range(1, rounds + 1):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total *= c * d
    return total


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised; where x is large its mirror image converges and is taken."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    z = np.clip(z, 0, 1)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    value = np.where(z <= 0, 0.0, front * _continued_fraction(p, q, z))
    return np.where(flip, 1 - value, value)


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def p_value(t: Column, df: Column) -> Column:
    """The two-sided p of Student's t; null where t or the degrees of freedom are."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        there = t.notna() & df.notna() & (df > 0)
        out = pd.Series(np.nan, index=t.index)
        out[there] = two_sided_p(t[there].to_numpy(), df[there].to_numpy())
        return out.astype(object).where(there, None)

    return p(t, df.cast("double"))


def correlation_t(r: Column, n: Column) -> Column:
    """The t of a correlation; null for a perfect one."""
    return F.when(F.abs(r) < 1, r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r)))


def with_q_values(tests: DataFrame, p: str = "p_value", *keys: str) -> DataFrame:
    """Add q_value by Benjamini and Hochberg: p times tests over rank, and never more than that of a larger p."""
    rank = Window.partitionBy(*keys).orderBy(p)
    from_top = Window.partitionBy(*keys).orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, 0)
    of = Window.partitionBy(*keys)
    raw = F.col(p) * F.count(p).over(of) / (F.rank().over(rank) + F.count("*").over(Window.partitionBy(*keys, p)) - 1)
    return tests.withColumn("_raw", raw).withColumn("q_value", F.least(F.lit(1.0), F.min("_raw").over(from_top))).drop("_raw")
