"""Order statistics of moving windows against sorting each window anew."""

import time

import numpy as np
import pandas as pd
import pytest

from tidemark.functions.order_windows import OrderStat, SortedWindow, add_level, robust_scores


def plain(kind, x, t, rows, least, q):
    w = x[max(0, t - rows + 1) : t + 1]
    w = w[~np.isnan(w)]
    if len(w) < max(least, 1) or (kind != "quantile" and np.isnan(x[t])):
        return np.nan
    if kind == "quantile":
        return np.quantile(w, q)
    if kind == "pct_rank":
        return np.mean(w <= x[t])
    if kind == "avg_rank":
        return ((w < x[t]).sum() + ((w == x[t]).sum() + 1) / 2) / len(w)
    low, high = np.quantile(w, [0.01, 0.99])
    c = np.clip(w, low, high)
    m = np.median(c)
    return (np.clip(x[t], low, high) - m) / (1.4826 * np.median(np.abs(c - m)) + 1e-12)


@pytest.mark.parametrize("kind", ["quantile", "pct_rank", "avg_rank", "robust_z"])
def test_each_kind_equals_the_sorted_window(kind):
    g = np.random.default_rng(7)
    for rows, least in ((1, 1), (2, 1), (7, 3), (60, 60), (60, 20)):
        x = np.round(g.normal(size=300) * 5) / (1 if rows < 60 else 3)
        x[g.random(300) < 0.1] = np.nan
        got = OrderStat(kind, "x", rows, least, 0.3).over(pd.Series(x)).to_numpy()
        want = np.array([plain(kind, x, t, rows, least, 0.3) for t in range(300)])
        flat = np.abs(want) > 1e6  # no deviation at all: only the sign means something
        assert np.allclose(got[~flat], want[~flat], equal_nan=True, rtol=1e-9) and (np.sign(got[flat]) == np.sign(want[flat])).all()


def test_deviation_picks_every_rank():
    g = np.random.default_rng(8)
    for n in range(1, 30):
        w = SortedWindow()
        for v in np.round(g.normal(size=n), 1):
            w.move(float(v), float("nan"))
        low, high, middle = w.sorted[0] + 0.05, max(w.sorted[-1] - 0.05, w.sorted[0] + 0.05), float(np.median(np.clip(w.sorted, w.sorted[0] + 0.05, max(w.sorted[-1] - 0.05, w.sorted[0] + 0.05))))
        want = np.sort(np.abs(np.clip(w.sorted, low, high) - middle))
        assert [w.deviation(k, middle, low, high) for k in range(n)] == pytest.approx(want.tolist())


def test_a_million_bars():
    x = pd.Series(np.random.default_rng(9).normal(size=1_000_000))
    start = time.time()
    for kind, rows in (("quantile", 2880), ("pct_rank", 2880)):
        assert OrderStat(kind, "x", rows, 100).over(x).notna().sum() == 1_000_000 - 99
    assert np.isfinite(robust_scores(x.to_numpy()[:200_000], 60, 60)[60:]).all()
    assert time.time() - start < 60


def test_a_level_of_columns_and_statistics(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", t, float(t % 5)) for t in range(40)] + [("b", 0, None)], "k string, ts long, x double")
    got = add_level(df, {"y": F.col("x") * 2, "med": OrderStat("quantile", "y", 5, 5, lag=1)}, ("k",)).orderBy("k", "ts").collect()
    assert [r.med for r in got[:6]] == [None] * 5 + [4.0] and got[-1].y is None and got[-1].med is None
