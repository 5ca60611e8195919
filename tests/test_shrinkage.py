"""Pooling along the whole hierarchy against a plain walk over it, and cases known by hand."""

import math

import numpy as np
import pytest

from tidemark.functions.tails import student_tail
from tidemark.operators.shrinkage import level_lambdas, shrink

SHAPE = "verb string, horizon string, family string, event string, state string, symbol string, n double, effect double, sd double, p_value double"
TOP, LEVELS = ["verb", "horizon"], ["family", "event", "state"]


def moments(rows):
    n = sum(r["n"] for r in rows)
    m = sum(r["n"] * r["effect"] for r in rows) / n if n else 0.0
    return n, m, sum(max(r["n"] - 1, 0) * r["sd"] ** 2 + r["n"] * (r["effect"] - m) ** 2 for r in rows) / max(n - 1, 1)


def strength(units, least=200.0, prev=None):
    n = sum(u[0] for u in units)
    if n < least:
        return 0.0, "insufficient_data"
    if sum(u[0] > 0 for u in units) <= 1:
        return 5000.0, "single_child"
    mean = sum(u[0] * u[1] for u in units) / n
    within = sum(max(u[0] - 1, 0) * u[2] for u in units) / max(sum(max(u[0] - 1, 0) for u in units), 1)
    lam = max(5.0, min(5000.0, within / max(sum(u[0] * (u[1] - mean) ** 2 for u in units) / n, 1e-8)))
    return (max(0.5 * prev, min(1.5 * prev, 0.9 * prev + 0.1 * lam)), "adaptive_smoothed") if prev else (lam, "adaptive")


def plain(rows, previous=None):
    part = lambda **k: [r for r in rows if all(r[a] == b for a, b in k.items())]
    out = {}
    for r in rows:
        keys, effect, said = {"verb": r["verb"], "horizon": r["horizon"]}, None, []
        effect = moments(part(**keys))[1]
        for level in LEVELS:
            units = [moments(part(**keys, **{level: v})) for v in sorted({x[level] for x in part(**keys)}) if level != "state" or v]
            lam, status = strength(units, prev=(previous or {}).get(level, {}).get(tuple(keys.values()))) if units else (None, None)
            keys = keys | {level: r[level]}
            n, m, _ = moments(part(**keys))
            w = 0.0 if level == "state" and not r[level] else 1.0 if status == "insufficient_data" else n / (n + lam)
            effect = w * m + (1 - w) * effect
            said.append(status)
        lam, status = strength([(x["n"], x["effect"], x["sd"] ** 2) for x in part(**keys)])
        lam = lam if status == "adaptive" else 100.0
        w = r["n"] / (r["n"] + lam)
        out[r["symbol"]] = (w * r["effect"] + (1 - w) * effect, w, lam, said)
    return out


def table(seed, count=120):
    g, rows = np.random.default_rng(seed), []
    for i in range(count):
        f, e = f"F{g.integers(3)}", f"E{g.integers(2)}"
        rows.append({"verb": f"v{g.integers(2)}".upper(), "horizon": "H", "family": f, "event": f + e, "state": ["", "S1", "S2", "S3"][g.integers(4)], "symbol": f"c{i}", "n": float(g.integers(0, 90)), "effect": float(g.normal(0.01 * g.integers(4), 0.02)), "sd": float(g.uniform(0.01, 0.3)), "p_value": 0.5})
    return rows


def test_same_as_a_walk(spark):
    rows = table(4)
    got = {r.symbol: r for r in shrink(spark.createDataFrame([tuple(r.values()) for r in rows], SHAPE), TOP, LEVELS).collect()}
    want = plain(rows)
    assert len(got) == len(rows) and {s for v in want.values() for s in v[3]} >= {"adaptive", "insufficient_data"}
    for r in rows:
        x, (effect, w, lam, said) = got[r["symbol"]], want[r["symbol"]]
        assert (x.effect_shrunk, x.weight, x["lambda"]) == pytest.approx((effect, w, lam), rel=1e-9)
        assert [x.status_family, x.status_event, x.status_state] == said
        if r["n"] > 1:
            assert x.p_shrunk == pytest.approx(2 * student_tail(effect / (r["sd"] / math.sqrt(r["n"])), r["n"] - 1))
        else:
            assert (x.p_shrunk, x.t_shrunk) == (0.5, 0.0)


def test_lambdas_of_the_run_before(spark):
    before, rows = table(5), table(6)
    frame = lambda rs: spark.createDataFrame([tuple(r.values()) for r in rs], SHAPE)
    old = level_lambdas(frame(before), TOP, LEVELS)
    known = {level: {tuple(r)[: 2 + i]: r["lambda"] for r in t.collect()} for i, (level, t) in enumerate(old.items())}
    got = {r.symbol: r for r in shrink(frame(rows), TOP, LEVELS, old).collect()}
    want = plain(rows, known)
    assert any("adaptive_smoothed" in v[3] for v in want.values())
    for s, (effect, w, lam, said) in want.items():
        assert (got[s].effect_shrunk, got[s].weight) == pytest.approx((effect, w), rel=1e-9)
        assert [got[s].status_family, got[s].status_event, got[s].status_state] == said


def test_large_n_stays_and_small_n_is_drawn(spark):
    rows = [("v", "h", "F", "E", "S", "big", 20000.0, 0.05, 0.1, None), ("v", "h", "F", "E", "S", "small", 5.0, -0.05, 0.1, None)]
    got = {r.symbol: r for r in shrink(spark.createDataFrame(rows, SHAPE), TOP, LEVELS).collect()}
    assert got["big"].effect_shrunk == pytest.approx(0.05, abs=1e-3) and got["small"].effect_shrunk > 0.04


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("v", "h", " f ", "e", None, "a", None, None, None, None), (None, None, None, None, None, "b", nan, inf, nan, 7.0), ("V", "h", "F", "E", " ", "c", 10.0, 0.1, 0.0, 0.2), ("v", "H", "f", "e", "s", "d", -3.0, 0.1, inf, nan),
        ("v", "h", "f", "e", "s", "d", 9.0, 0.2, 0.1, 0.3), ("v", "h", "f", "e", "s", "d", 9.0, 0.2, 0.1, 0.3),
    ]
    frame = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS _all", "'x' AS status")
    got = shrink(frame, TOP, LEVELS).collect()
    assert len(got) == 6 and all(r[k] is not None and math.isfinite(r[k]) for r in got for k in ("weight", "effect_shrunk", "t_shrunk", "p_shrunk")) and all(r.status == "x" for r in got)
    by = {r.symbol: r for r in got}
    assert (by["a"].weight, by["a"].p_shrunk, by["b"].effect_shrunk, by["b"].p_shrunk, by["c"].p_shrunk, by["a"].weight_state) == (0.0, 1.0, 0.0, 1.0, 0.2, 0.0)
    # one unit above: what little there is stands by itself, and the candidate is drawn towards it
    assert by["c"].effect_event == pytest.approx((10 * 0.1 + 18 * 0.2) / 28) and by["c"].weight == pytest.approx(10 / 110)
    assert shrink(frame.limit(0), TOP, LEVELS).count() == 0
