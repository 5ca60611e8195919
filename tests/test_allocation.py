"""Shared exposure against a plain walk over the bars, with chunks of any size."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.allocation import Limits, allocate, allocation_summary, last_position, step_line

START = dt.datetime(2024, 1, 1)
SHAPE = "book string, ts timestamp, strategy string, position double, scale double"


def plain(rows, limits, profit, regimes):
    """{(book, ts, strategy): (requested, allocated, scale)} by walking along each book."""
    out = {}
    for book in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == book]
        times, names = sorted({r[1] for r in own}), sorted({r[2] for r in own}, key=str)
        held = {(r[1], r[2]): ((r[3] or 0.0), max(0.0, r[4] or 0.0)) for r in own}
        pnl = pd.Series([profit.get((book, t)) or 0.0 for t in times])
        sd = pnl.rolling(limits.window, min_periods=limits.least).std()
        equity = peak = 1.0
        peak = None
        before = dict.fromkeys(names, 0.0)
        for i, t in enumerate(times):
            want = {n: math.prod(held.get((t, n), (0.0, 1.0))) for n in names}
            x = {n: max(-limits.strategy, min(limits.strategy, v)) for n, v in want.items()}
            gross = sum(map(abs, x.values()))
            x = {n: v * (limits.symbol / gross if gross > limits.symbol else 1.0) for n, v in x.items()}
            gross, net = sum(map(abs, x.values())), sum(x.values())
            if limits.one_sided is not None and abs(abs(net) - gross) < 1e-9 and gross > limits.one_sided:
                x = {n: v * limits.one_sided / gross for n, v in x.items()}
            factor = min(1.0, max(0.0, dict(limits.regimes).get(regimes.get((book, t)), 1.0)))
            equity *= 1 + pnl[i]
            peak = equity if peak is None else max(peak, equity)
            if limits.volatility is not None:
                year = sd[i] * math.sqrt(limits.bars_a_year)
                factor *= min(limits.most_leverage, limits.volatility / year) if year > 0 else 1.0
            if limits.drawdown is not None:
                factor *= max(0.0, min(1.0, (limits.drawdown - ((peak - equity) / peak if peak else 0.0)) / limits.drawdown))
            x = {n: v * factor for n, v in x.items()}
            gross = sum(map(abs, x.values()))
            x = {n: v * (limits.portfolio / gross if gross > limits.portfolio else 1.0) for n, v in x.items()}
            for n in names:
                before[n] += max(-limits.step, min(limits.step, x[n] - before[n]))
                p = abs(held.get((t, n), (0.0, 1.0))[0])
                out[book, t, n] = (want[n], before[n], abs(before[n]) / p if p else 0.0)
    return out


def table(g, books, bars):
    rows, profit, regimes = [], {}, {}
    for book in books:
        for i in range(bars):
            t = START + dt.timedelta(hours=i * (i % 3 + 1))
            for s in ("a", "b", None):
                if g.random() < 0.85:
                    rows.append((book, t, s, None if g.random() < 0.05 else float(g.normal(0.2, 0.7)), None if g.random() < 0.05 else float(g.normal(1, 0.5))))
            if g.random() < 0.9:
                profit[book, t] = None if g.random() < 0.05 else float(g.normal(0, 0.03))
            regimes[book, t] = [None, "HIGH_VOL", "CHOP", "OTHER"][g.integers(4)]
    return list({(r[0], r[1], r[2]): r for r in rows}.values()), profit, regimes


FULL = Limits(strategy=0.8, symbol=1.2, portfolio=0.9, one_sided=1.0, step=0.15, volatility=0.4, drawdown=0.3, regimes=(("HIGH_VOL", 0.6), ("CHOP", 1.5)), window=20, least=5, bars_a_year=252.0)


@pytest.mark.parametrize("limits, chunk", [(FULL, 7), (FULL, 8192), (Limits(step=0.0), 16), (Limits(strategy=0.0), 16), (Limits(step=0.01, portfolio=2.0, symbol=5.0), 5), (Limits(drawdown=0.05), 9)])
def test_same_as_a_walk(spark, limits, chunk):
    rows, profit, regimes = table(np.random.default_rng(3), ["x", None], 70)
    p = spark.createDataFrame([(*k, v) for k, v in profit.items()], "book string, ts timestamp, pnl double")
    r = spark.createDataFrame([(*k, v) for k, v in regimes.items()], "book string, ts timestamp, regime string")
    got = allocate(spark.createDataFrame(rows, SHAPE), ["book"], "ts", "strategy", limits, p, r, chunk).collect()
    want = plain(rows, limits, profit, regimes)
    assert len(got) == len(want)
    for x in got:
        assert (x.requested, x.allocated, x.scale) == pytest.approx(want[x.book, x.ts, x.strategy], abs=1e-9)


def test_a_whole_loss_leaves_nothing(spark):
    rows = [("x", START + dt.timedelta(hours=i), "a", 1.0, 1.0) for i in range(9)]
    p = spark.createDataFrame([("x", START + dt.timedelta(hours=i), v) for i, v in ((1, 0.5), (3, -2.0), (5, -0.5))], "book string, ts timestamp, pnl double")
    got = allocate(spark.createDataFrame(rows, SHAPE), ["book"], "ts", "strategy", Limits(drawdown=0.5, step=9.0), p, chunk=2).orderBy("ts").collect()
    assert [x.allocated for x in got] == [1.0] * 3 + [0.0] * 6


def test_empty_tables_and_wrong_limits(spark):
    empty = spark.createDataFrame([], SHAPE)
    out = allocate(empty, ["book"], "ts", "strategy", FULL, spark.createDataFrame([], "book string, ts timestamp, pnl double"), spark.createDataFrame([], "book string, ts timestamp, regime string"))
    assert out.columns == ["book", "ts", "strategy", "requested", "allocated", "scale"] and out.count() == 0
    with pytest.raises(ValueError):
        allocate(empty, [], "ts", "strategy", FULL)
    with pytest.raises(ValueError):
        Limits(drawdown=0.0)
    with pytest.raises(ValueError):
        Limits(portfolio=math.inf)


def test_summary(spark):
    rows = [("x", 2.0, 1.0), ("x", -2.0, -1.0), ("y", 0.0, 0.0)]
    got = allocation_summary(spark.createDataFrame(rows, "book string, requested double, allocated double"), ["book"]).orderBy("book").collect()
    assert [tuple(r) for r in got] == [("x", 4.0, 2.0, 0.5), ("y", 0.0, 0.0, 0.0)]


@pytest.mark.parametrize("seed", range(8))
def test_line_of_a_chunk(seed):
    g = np.random.default_rng(seed)
    step, targets = float(g.uniform(0.01, 0.5)), g.uniform(-1, 1, int(g.integers(1, 60)))
    u, v = step_line(targets, step, 1.0)
    assert len(u) <= 4 / step + 6
    for begin in g.uniform(-1, 1, 30):
        assert np.interp(begin, u, v) == pytest.approx(last_position(targets, step, begin)[-1], abs=1e-12)
