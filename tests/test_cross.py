"""Cross-sections against numpy."""

import math

import numpy as np
import pytest

from tidemark.operators.cross import cross_section, momentum

SHAPE = "t long, s string, x double"


def test_same_as_numpy(spark):
    g = np.random.default_rng(2)
    rows = [(t, f"s{i}", float(np.round(g.normal(), 1))) for t in range(12) for i in range(t)] + [(5, "no", None), (5, "nan", math.nan), (5, "inf", math.inf), (None, "a", 1.0), (None, "b", 1.0), (None, "c", 1.0)]
    got = cross_section(spark.createDataFrame(rows, SHAPE), ["t"], "x").collect()
    assert len(got) == sum(t for t in range(12) if t >= 3) + 3
    for r in got:
        x = np.array([v for t, _, v in rows if t == r.t and v is not None and math.isfinite(v)])
        mad = np.median(np.abs(x - np.median(x)))
        want = (len(x), x.mean(), x.std(ddof=1), np.median(x), mad, (r.x - x.mean()) / (x.std(ddof=1) + 1e-12), (r.x - np.median(x)) / (1.4826 * mad + 1e-12), len({v for v in x if v <= r.x}) / len(x))
        assert (r.n, r.cs_mean, r.cs_std, r.cs_median, r.cs_mad, r.cs_z, r.cs_robust_z, r.cs_rank) == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_equal_values_and_empty(spark):
    got = cross_section(spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (1, "c", 2.0)], SHAPE), ["t"], "x").collect()
    assert {(r.cs_z, r.cs_robust_z, r.cs_rank) for r in got} == {(0.0, 0.0, 1 / 3)}
    assert cross_section(spark.createDataFrame([], SHAPE), ["t"], "x").count() == 0


def test_momentum(spark):
    rows = [(t, s, v * (t + 1) ** k) for t in range(4) for s, v, k in (("a", 1.0, 1), ("b", 5.0, 2), ("c", 2.0, 0), ("d", -1.0, 1))]
    got = {(r.t, r.s): (r.ret, r.score) for r in momentum(spark.createDataFrame(rows, SHAPE), ["s"], "t", "x", 2).collect()}
    assert sorted(got) == [(t, s) for t in (2, 3) for s in "abc"]
    assert got[3, "b"] == pytest.approx((2 * math.log(2), 1.0)) and got[3, "c"] == pytest.approx((0.0, 2 / 3 - 1)) and got[3, "a"] == pytest.approx((math.log(2), 4 / 3 - 1))
