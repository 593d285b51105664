"""Distribution functions for test statistics. They run on the few rows of a result table."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction (modified Lentz)."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + n * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + n / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def _each(f):
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*map(float, row)) for row in zip(*columns, strict=True)], dtype="float64")

    return run


@F.pandas_udf(DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided)(t, df)


@F.pandas_udf(DoubleType())
def f_test_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _each(f_upper)(f, df1, df2)
