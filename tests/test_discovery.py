"""Queries without a statement against brute force, and small cases of the operators behind the others."""

import math
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd

from tidemark.plans import discovery as D
from tidemark.streaming.streams import stream_cooldown


def series(n, seed, ties=False):
    r = np.random.default_rng(seed)
    x = r.normal(size=n)
    y = 0.5 * x + r.normal(size=n)
    return (np.round(x, 1), np.round(y, 1)) if ties else (x, y)


def tau_b(x, y):
    pairs = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(len(x)) for j in range(i)]
    a, b = sum(p != 0 for p, _ in pairs), sum(q != 0 for _, q in pairs)
    return sum(p * q for p, q in pairs) / math.sqrt(a * b)


def test_kendall_tau_with_and_without_ties(spark):
    made = {"plain": series(90, 1), "ties": series(120, 2, True), "same": (np.arange(20.0), np.arange(20.0)), "against": (np.arange(9.0), -np.arange(9.0))}
    rows = [(k, float(a), float(b)) for k, (x, y) in made.items() for a, b in zip(x, y)] + [("ties", None, 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0)]
    got = {r.pair: r.tau for r in D.kendall_tau(spark.createDataFrame(rows, "pair string, r1 double, r2 double"), "pair", "r1", "r2").collect()}
    assert got.pop("flat") is None
    assert set(got) == set(made) and all(abs(got[k] - tau_b(*made[k])) < 1e-12 for k in made)


def test_copula_events(spark):
    x, y = series(400, 3, True)
    frame = pd.DataFrame({"pair": "a/b", "ts": pd.date_range("2024-01-01", periods=400, freq="h"), "bar": np.arange(1, 401), "r1": x, "r2": y})
    got = D.copula_events(spark.createDataFrame(frame), 0.05, 0.95, 12, 288).orderBy("bar").collect()
    normal = NormalDist()
    z1, z2 = [[normal.inv_cdf(min(max(u, 1e-6), 1 - 1e-6)) for u in frame[c].rank(pct=True)] for c in ("r1", "r2")]
    rho = np.corrcoef(z1, z2)[0, 1]
    index = [normal.cdf((a - rho * b) / math.sqrt(1 - rho * rho)) for a, b in zip(z1, z2)]
    want, free = [], 0
    for bar, p in enumerate(index, 1):
        if bar >= free and (p < 0.05 or p > 0.95):
            want.append((bar, round(p, 6)))
            free = bar + 13
    assert [(r.bar, r.mispricing) for r in got] == want and len(want) > 5
    assert D.copula_events(spark.createDataFrame(frame.head(100)), 0.05, 0.95, 12, 288).count() == 0


def test_linear_probability(spark):
    r = np.random.default_rng(5)
    n = 1500
    f = pd.DataFrame({"period": r.choice(["1", "2", "3"], n), **{c: r.integers(0, 2, n).astype(float) for c in D.TERMS[1:5]}})
    f["y"] = (r.random(n) < 0.3 + 0.4 * f.persistence * f.is_bull).astype(float)
    got = {g.term: g for g in D.linear_probability(spark.createDataFrame(f)).collect()}
    x = np.column_stack([np.ones(n), f[D.TERMS[1:5]], *[f.persistence * f[c] for c in D.TERMS[2:5]]])
    fit = lambda m: np.linalg.lstsq(x[m], f.y.to_numpy()[m], rcond=None)[0][5:]
    whole, parts = fit(np.ones(n, bool)), [fit((f.period == p).to_numpy()) for p in "123"]
    for i, term in enumerate(D.TERMS[5:]):
        assert abs(got[term].full_coef - whole[i]) < 1e-6 and got[term].signs == ",".join(str(int(np.sign(p[i]))) for p in parts)
    assert got["p_x_bull"].status == "pass"
    few = D.linear_probability(spark.createDataFrame(f), least=10_000).collect()
    assert {g.status for g in few} == {"insufficient"}


def test_ema_across_blocks(spark):
    x = np.random.default_rng(7).normal(size=500)  # blocks of 130
    rows = [("s", k, float(v)) for k, v in enumerate(x, 1)]
    got = [r.ema for r in D.ema(spark.createDataFrame(rows, "s string, k long, v double"), "s", "k", "v", 0.9).orderBy("k").collect()]
    want = [x[0]]
    for v in x[1:]:
        want.append(0.9 * v + 0.1 * want[-1])
    assert np.allclose(got, want, atol=1e-12)


def test_quoted_cost_falls_back(spark):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    events = spark.createDataFrame([("a", at(h)) for h in range(5)] + [("b", at(0)), ("b", at(50))], "symbol string, ts timestamp_ntz")
    quotes = spark.createDataFrame([("a", at(h), 2.0, 100.0) for h in range(5)] + [("b", at(0), 2.0, 100.0)], "symbol string, ts timestamp_ntz, spread_bps double, depth double")
    got = {r.symbol: (r.coverage, r.cost_bps, r.source) for r in D.quoted_cost(events, quotes).collect()}
    assert got == {"a": (1.0, 6.0, "tob_regime"), "b": (0.5, 6.0, "fallback")}


def test_crossover_and_shape(spark):
    liq = [0.0, 0.1, 0.1, 0.3, 0.3, 0.3] + [0.3] * 18
    vol = [0.2, 0.3, 0.2, 0.1, 0.1, 0.1] + [0.0] * 18
    curves = spark.createDataFrame([("a", k, float(x), float(y)) for k, (x, y) in enumerate(zip(liq, vol), 1)], "symbol string, age int, liq double, vol double")
    assert D.crossover(curves).first().crossover == 3
    assert D.hazard_shape(curves).first()[1:] == (True, True, True)


def test_shrinkage_p_values(spark):
    rows = D.shrinkage_p_values(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(0 <= r.p_value <= 1 for r in rows)
    for r in (r for r in rows if r.n > 200):  # close to the normal tail
        assert abs(r.p_value - math.erfc(abs(r.t_stat) / math.sqrt(2))) < 5e-3


def test_stream_cooldown_over_triggers(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    parts = [[(1, at(0), "a"), (2, at(0), "a"), (3, at(30), "a"), (4, at(61), "b")], [(5, at(59), "a"), (6, at(60), "a"), (7, None, "a"), (8, at(121), "b")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = stream_cooldown(stream, "event_type", pd.Timedelta(hours=1)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.event_type, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1), ("a", 6), ("b", 4), ("b", 8)]
