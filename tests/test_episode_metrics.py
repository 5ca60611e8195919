"""Shocks and vacuums with their metrics against a walk over pandas rows, at the default windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.spans import rows_within
from tidemark.plans.episode_metrics import Vacuum, VolShock, calibrate, vacuums, vol_shocks
from tidemark.plans.panel import numbered


@pytest.fixture(scope="module")
def panel(spark):
    """Two symbols of 2,500 hourly bars whose volatility and volume come in bursts, with a few missing closes."""
    g, frames = np.random.default_rng(12), []
    for symbol in ("a", "b"):
        n = 2500
        burst = np.exp(np.repeat(g.normal(size=n // 25) * 0.9, 25)) * 0.01
        close = 100 * np.exp(np.cumsum(g.normal(size=n) * burst))
        width = burst * close * (0.5 + g.random(n))
        # a jump of the price makes the volume dry up for some bars
        jump = np.abs(np.diff(np.log(close), prepend=np.log(close[0])))
        dry = pd.Series(jump > np.quantile(jump, 0.97)).shift(1, fill_value=False).rolling(6, min_periods=1).max().to_numpy()
        frames.append(pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "close": close, "high": close + width * (1 + dry), "low": close - width * (1 + dry), "volume": np.exp(g.normal(size=n) * 0.2) * (1 - 0.8 * dry)}))
    pdf = pd.concat(frames)
    gaps = g.random(len(pdf)) < 0.0004
    pdf.loc[gaps, ["close", "high", "low"]] = np.nan
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("close", "high", "low")}).repartition(4)
    return {s: p.reset_index(drop=True) for s, p in pdf.groupby("symbol")}, numbered(df)


def walk_shocks(p):
    logret = np.log(p.close / p.close.shift(1))
    rv = np.sqrt((logret**2).rolling(12, min_periods=12).mean())
    base = rv.rolling(288, min_periods=288).median()
    shock = (rv / base).round(9)
    cut, n, out, free = round(shock.quantile(0.99), 9), len(p), [], 0
    for i in range(1, n):
        if i < free or not (shock[i] >= cut and shock[i - 1] < cut):
            continue
        calm, leave = 0, n - 1
        for j in range(i, n):
            calm = calm + 1 if shock[j] <= 1.25 else 0
            if calm == 3:
                leave = j
                break
        free = leave + 13
        inside, post = rv[i : leave + 1], slice(i, min(n, i + 97))
        peak, top = inside.max(), int(inside.idxmax())
        half = next((h for h in range(min(96, n - i)) if rv[i + h] <= base[i] + 0.5 * (peak - base[i])), None)
        second = next((k - i for k in range(top + 1, min(leave, i + 96) + 1) if k < n and shock[k] >= cut), None)
        r = logret[post].dropna()
        out.append((i + 1, leave + 1, leave - i + 1, peak, top - i, base[i], half, (rv[post] - base[i]).clip(lower=0).sum(), second, rv[post].mean(), rv[post].quantile(0.9), (p.high[post].max() - p.low[post].min()) / p.close[i], leave - i <= 96, r.skew(), r.kurtosis()))
    return out


def same(got, want):
    return len(got) == len(want) and all((g is None) == (w is None) and (g is None or g == pytest.approx(w, rel=1e-9, abs=1e-12)) for a, b in zip(got, want) for g, w in zip(a, b, strict=True))


def test_vol_shocks(panel):
    pandas, bars = panel
    got = vol_shocks(bars).orderBy("symbol", "enter_bar").collect()
    for s, p in pandas.items():
        mine = [(r.enter_bar, r.exit_bar, r.duration, r.rv_peak, r.t_rv_peak, r.rv_base, r.half_life, r.auc_excess, r.time_to_secondary, r.rv_mean, r.rv_p90, r.range_pct, r.relaxed, r.skew, r.kurtosis) for r in got if r.symbol == s]
        want = walk_shocks(p)
        assert want and same(mine, want)
    assert all(r.secondary == (r.time_to_secondary is not None) and r.time_to_relax == r.duration - 1 for r in got)
    assert vol_shocks(bars.limit(0)).count() == 0 and vol_shocks(bars, VolShock(base_window=600, rv_window=30)).columns == vol_shocks(bars).columns


def walk_vacuums(p, cut, rule):
    back = p.close / p.close.shift(1)
    ret, width = (back - 1).abs().round(9), (p.high - p.low) / p.close
    mid, wide = p.volume.rolling(480, min_periods=480).median(), width.rolling(480, min_periods=480).median()
    n, out, free = len(p), [], 0
    for i in range(1, n):
        if i < free or not (ret[i] >= cut and ret[i - 1] < cut):
            continue
        j = i + 1
        while j < n and j - i <= rule.most_bars and p.volume[j] / mid[j] < rule.volume_floor and width[j] > rule.range_multiple * wide[j]:
            j += 1
        leave = j - 1
        if leave - i < rule.least_bars:
            continue
        free = leave + rule.cooldown + 1
        a, inside, post = i + 1, width[i + 1 : leave + 1], slice(leave + 1, min(n, leave + 1 + rule.post))
        half = next((k for k in range(len(inside)) if inside.iloc[k] <= wide[a] + 0.5 * (inside.max() - wide[a])), None)
        out.append((a + 1, leave + 1, leave - i, ret[i], inside.max(), int(inside.idxmax()) - a, half, bool((ret[post] >= cut).any()), bool((width[post] >= rule.expansion).any()), (width[a : leave + rule.auc + 1] - wide[a]).clip(lower=0).sum()))
    return out


def test_vacuums_and_their_calibration(panel):
    pandas, bars = panel
    for rule in (Vacuum(shock_quantile=0.97), Vacuum(shock_quantile=0.97, least_bars=1, most_bars=2, cooldown=0)):
        got = vacuums(bars, rule).orderBy("symbol", "enter_bar").collect()
        for s, p in pandas.items():
            ret = (p.close / p.close.shift(1) - 1).abs().round(9)
            want = walk_vacuums(p, round(ret.quantile(0.97), 9), rule)
            mine = [(r.enter_bar, r.exit_bar, r.duration, r.shock_return, r.max_range, r.t_range_peak, r.half_life, r.secondary_shock, r.range_expansion, r.auc_excess) for r in got if r.symbol == s]
            assert want and same(mine, want)
    sweep, rule = [0.9, 0.95, 0.97, 0.99], Vacuum()
    table = {(r.symbol, r.quantile): r for r in calibrate(bars, sweep, 10, rule).collect()}
    for s, p in pandas.items():
        ret = (p.close / p.close.shift(1) - 1).abs().round(9)
        n = [len(walk_vacuums(p, round(ret.quantile(q), 9), rule)) for q in sweep]
        chosen = next((q for q, k in zip(sweep, n) if k >= 10), sweep[-1])
        assert [table[s, q].n for q in sweep] == n and [q for q in sweep if table[s, q].chosen] == [chosen]
    assert vacuums(bars.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [1, 10, 128])
def test_rows_within_overlapping_spans(spark, bucket):
    bars = spark.createDataFrame([(s, i) for s in "ab" for i in range(-20, 60)], "s string, at long")
    spans = [("a", 0, 5), ("a", 3, 40), ("b", -5, -2), ("b", 9, 8), ("c", 1, 2), ("b", 55, 500)]
    got = rows_within(bars, spark.createDataFrame(spans, "s string, f long, l long"), ["s"], "at", "f", "l", bucket)
    assert sorted(map(tuple, got.select("s", "f", "l", "at").collect())) == sorted((s, f, z, i) for s, f, z in spans for i in range(-20, 60) if f <= i <= z and s != "c")
