"""Tail probabilities that Spark SQL has no function for, as Arrow column functions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def student_tail(t: float, df: float) -> float:
    """P(T > |t|) of Student's distribution, by the continued fraction of the incomplete beta function."""
    if not df > 0 or math.isnan(t):
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    part = front * h / a
    return 0.5 * (1 - part if flip else part)


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), na_action="ignore").astype(float)


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """The standard normal's quantile of shares, kept 1e-6 away from 0 and 1."""
    return p.clip(1e-6, 1 - 1e-6).map(NormalDist().inv_cdf, na_action="ignore").astype(float)


@F.pandas_udf(DoubleType())
def normal_two_sided(t: pd.Series) -> pd.Series:
    return t.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore").astype(float)


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([np.nan if pd.isna(a) or pd.isna(b) else 2 * student_tail(a, b) for a, b in zip(t, df, strict=True)])
