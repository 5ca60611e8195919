"""Costs, tests by split and promotion of candidates against plain Python."""

import math

import numpy as np
import pytest

from tidemark.operators.gates import CostModel, Promotion, candidate_costs, promote, split_tests


def test_split_p_is_the_normal_tail(spark):
    g = np.random.default_rng(1)
    rows = [("a", "train", float(x)) for x in g.normal(0.3, 1, 40)] + [("a", "test", 1.0), ("b", "train", 2.0), ("b", "train", 2.0), ("b", "other", 9.0), ("a", "train", float("nan")), ("a", "train", None)]
    got = {r.k: r for r in split_tests(spark.createDataFrame(rows, "k string, split string, x double"), ["k"], "split", "x", ["train", "test"]).collect()}
    x = np.array([v for k, s, v in rows if k == "a" and s == "train" and v is not None and v == v])
    t = x.mean() / (x.std(ddof=1) / math.sqrt(len(x)))
    a = got["a"]
    assert a.train_n == 40 and a.train_t == pytest.approx(t) and a.train_p == pytest.approx(math.erfc(abs(t) / math.sqrt(2)))
    assert (a.test_n, a.test_t, a.test_p, a.test_mean) == (1, None, None, 1.0) and (got["b"].train_n, got["b"].train_t) == (2, None)


COLUMNS = "c string, action string, expectancy double, spread_bps double, atr double, quote_volume double, close double, high double, low double, tob_coverage double"


def plain_cost(row, turn, scarce, m):
    _, _, _, spread, atr, volume, close, high, low, tob = row
    avail = max(volume or 1e6, 1.0)
    vol = atr / close * 1e4 if atr is not None and close else (high - low) / close * 1e4 if close and high is not None else 0.0
    part = turn / avail
    penalty = math.exp(min(5.0, max(0.0, (part - m.most_participation) / m.most_participation))) - 1
    moving = m.spread_weight * (spread or 0.0) + m.volatility_weight * abs(vol) + m.liquidity_weight * 10 / avail / scarce + m.impact_weight * (10 * math.sqrt(part) + 50 * penalty)
    return min(m.cap, max(0.0, m.fee + (moving if (tob or 0.0) >= m.least_coverage else m.slippage)))


@pytest.mark.parametrize("action, turn", [("no_action", 1.0), ("entry_gate_skip", 0.0), ("risk_throttle_0.25", 0.25), ("risk_throttle_7", 1.0), ("risk_throttle_x", 1.0), ("delay_3", 1.0)])
def test_costs_by_hand(spark, action, turn):
    m = CostModel(least_coverage=0.5, most_participation=1e-4)
    rows = [("k", action, 0.001, 3.0, 0.5, 5000.0, 100.0, 101.0, 99.0, 0.9), ("k", action, 0.001, None, None, 0.0, 100.0, 100.5, 99.5, 0.9), ("k", action, 0.001, 3.0, 0.5, 50.0, 0.0, 1.0, 1.0, 0.9), ("k", action, 0.001, 9.0, 0.1, 100.0, 10.0, 11.0, 9.0, None)]
    r = candidate_costs(spark.createDataFrame(rows, COLUMNS), ["c"], "expectancy", m).first()
    scarce = max(1 / max(x[5] or 1e6, 1.0) for x in rows)
    costs = [plain_cost(x, turn, scarce, m) for x in rows]
    per = np.mean(costs) * turn / 1e4
    assert (r.n, r.turnover) == (4, turn) and r.cost_bps == pytest.approx(np.mean(costs)) and r.coverage == pytest.approx(19 / 20)
    assert r.after_cost == pytest.approx(0.001 - per) and r.stressed == pytest.approx(0.001 - 1.5 * per) and r.cost_ratio == pytest.approx(per / (0.001 + per))
    assert (r.gate_after_cost, r.gate_stressed, r.gate_model, r.gate_ratio) == (0.001 > per, 0.001 > 1.5 * per, True, per / (0.001 + per) < 0.6)


SHAPE = "candidate_id string, event_type string, plan_row_id string, n_events long, q_value double, effect double, std double, gate_stability boolean, gate_delay boolean, t_values array<double>, cost_gates array<boolean>, tob_coverage double, validation_samples long"
GOOD = ("good", "E", "p1", 500, 0.01, 0.02, 0.1, True, True, [1.0, 2.0, None], [True, True, True, True], 0.9, 40)


def changed(name, **other):
    row = dict(zip([c.split()[0] for c in SHAPE.split(", ")], GOOD, strict=True)) | {"candidate_id": name} | other
    return tuple(row.values())


def test_each_gate_rejects_by_itself(spark):
    rows = [
        GOOD, changed("q", q_value=0.5), changed("n", n_events=3), changed("unstable", gate_stability=False), changed("small", effect=0.001), changed("signs", t_values=[1.0, -1.0]), changed("late", gate_delay=False), changed("dear", cost_gates=[True, False, None]),
        changed("control", event_type="F"), changed("idle", plan_row_id="p2"), changed("nowhere", plan_row_id="p9"), changed("nameless", plan_row_id=" "), changed("unseen", validation_samples=0), changed("dark", tob_coverage=0.1), changed("down", effect=-0.02, t_values=[-1.0, -3.0]),
        changed("bare", q_value=None, t_values=[], cost_gates=None, std=None),
    ]
    audit = spark.createDataFrame([("p1", False), ("p1", True), ("p2", False)], "plan_row_id string, executed boolean")
    controls = spark.createDataFrame([("E", 0.005), ("F", 0.5), (None, 0.9)], "event_type string, rate double")
    table = spark.createDataFrame(rows, SHAPE)
    got = {r.candidate_id: r for r in promote(table, audit, controls, Promotion(require_audit=True)).collect()}
    reasons = {
        "good": "", "q": "statistical_q_value", "n": "statistical_min_events", "unstable": "stability_gate", "small": "stability_score", "signs": "stability_sign_consistency", "late": "delay_robustness_fail", "dear": "cost_survival", "control": "negative_control_fail",
        "idle": "hypothesis_not_executed", "nowhere": "hypothesis_missing_audit", "nameless": "hypothesis_missing_plan_row_id", "unseen": "no_validation_samples", "dark": "", "down": "", "bare": "cost_survival|statistical_q_value",
    }
    assert {c: r.reasons for c, r in got.items()} == reasons
    assert {c for c, r in got.items() if r.promoted} == {"good", "dark", "down"} and got["dark"].track == "fallback_only" and got["good"].track == "standard"
    assert got["good"].score == 1.0 and got["dark"].score == pytest.approx(5 / 6) and got["idle"].score == 1.0 and got["bare"].first_failed == "statistical_q_value"
    lax = {r.candidate_id: r for r in promote(table, audit, controls.limit(0), Promotion(least_stability=0.0, allow_missing_controls=True)).collect()}
    assert lax["unstable"].promoted and lax["late"].promoted and lax["nowhere"].promoted and not lax["idle"].promoted
    assert promote(table, audit, controls.limit(0)).where("promoted").count() == 0  # no control rate is known
