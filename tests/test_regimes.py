"""Profit by regime against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.regimes import regime_performance, volatility_segments


def test_same_as_pandas(spark):
    g = np.random.default_rng(7)
    rows = [(["up", "down", None][g.integers(3)], dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), None if i % 11 == 0 else float(g.normal())) for i in range(400)] + [("one", dt.datetime(2024, 1, 1), -2.0), ("none", dt.datetime(2024, 1, 1), None)]
    got = {r.k: r for r in regime_performance(spark.createDataFrame(rows, "k string, ts timestamp, x double"), ["k"], "ts", "x", days=5).collect()}
    assert set(got) == {"up", "down", None, "one"}
    for k, r in got.items():
        x = pd.Series([v for a, _, v in rows if a == k and v is not None])
        cum = x.cumsum()
        assert (r.n, r.total, r.mean, r.max_drawdown) == pytest.approx((len(x), x.sum(), x.mean(), (cum.cummax() - cum).max()))
        assert (r.sd, r.sharpe) == (pytest.approx((x.std(), x.mean() / x.std())) if len(x) > 1 else (None, 0.0))


def test_segments(spark):
    rows = [("a", float(i), float(v)) for i, v in enumerate([1, 2, 3, 4, 5])] + [("a", None, 9.0), ("b", 1.0, 2.0), (None, 1.0, None)]
    got = {r.k: tuple(r)[1:] for r in volatility_segments(spark.createDataFrame(rows, "k string, x double, v double"), ["k"], "x", "v", bars_a_year=1.0).collect()}
    assert got == {"a": (3.5, 2.0, 0.5, 0.4), "b": (1.0, 0.0, 1.0, 1.0)}
