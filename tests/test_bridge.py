"""Candidates judged after costs, against rows worked out by hand."""

import pytest

from tidemark.operators.bridge import bridge, fail_summary

SHAPE = "event string, candidate_id string, action string, condition string, after_cost double, stressed double, cost_bps double, turnover double, cost_ratio double, validation_samples long, base string"


def judged(spark, rows, **other):
    return {r.candidate_id: r for r in bridge(spark.createDataFrame(rows, SHAPE), ["event"], **other).collect()}


GOOD = ("E", "good", "no_action", "all", 0.0020, 0.0010, 8.0, 0.5, 0.2, 40, None)


def changed(name, **other):
    return tuple((dict(zip([c.split()[0] for c in SHAPE.split(", ")], GOOD, strict=True)) | {"candidate_id": name, "condition": name} | other).values())


def test_costs_and_edges(spark):
    r = judged(spark, [GOOD])["good"]
    assert (r.kind, r.base, r.trades, r.tradable, r.reasons, r.first_failed) == ("standalone", None, 40, True, "", None)
    assert (r.cost, r.validation, r.train, r.under_stress, r.gross_edge, r.edge_to_cost, r.score) == pytest.approx((4, 20, 20, 10, 24, 6, 20))
    assert (r.edge_x0_5, r.edge_x1_0, r.edge_x1_5, r.edge_x2_0) == pytest.approx((22, 20, 18, 16))


def test_each_gate_fails_by_itself(spark):
    rows = [changed("few", validation_samples=3), changed("stress", stressed=-0.001), changed("dear", cost_bps=100.0), changed("often", turnover=1.2), changed("loss", after_cost=-0.001), changed("unknown", validation_samples=None)]
    got = {k: (r.tradable, r.reasons, r.first_failed) for k, r in judged(spark, rows).items()}
    assert got == {
        "few": (False, "has_trades", "has_trades"), "stress": (False, "stressed,turnover", "stressed"), "dear": (False, "edge_cost", "edge_cost"), "often": (False, "turnover", "turnover"),
        "loss": (False, "after_cost,edge_cost", "after_cost"), "unknown": (False, "has_trades", "has_trades"),
    }


def test_cost_from_a_share_and_awkward_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [changed("share", cost_bps=None, cost_ratio=0.25), changed("all", cost_bps=0.0, cost_ratio=7.0), changed("none", cost_bps=nan, cost_ratio=None), changed("idle", turnover=None), changed("odd", after_cost=inf, stressed=nan, cost_ratio=nan, cost_bps=-1.0)]
    got = judged(spark, rows)
    assert {k: r.cost for k, r in got.items()} == pytest.approx({"share": 5.0, "all": 20.0, "none": 0.0, "idle": 0.8, "odd": 0.0})
    assert (got["odd"].validation, got["odd"].under_stress, got["odd"].tradable) == (0.0, 0.0, False)


def test_without_a_figure_under_stress(spark):
    assert judged(spark, [changed("x", stressed=None)])["x"].under_stress == pytest.approx(20)


def test_overlays_against_their_bases(spark):
    rows = [
        GOOD, changed("throttle", action="risk_throttle_0.5", condition="all", after_cost=0.0025, stressed=0.002, turnover=0.25), changed("more", action="Entry_Gate_Skip", condition="all", after_cost=0.0025, stressed=0.002, turnover=0.75),
        changed("lost", action="entry_gate_skip", condition="nowhere"), changed("given", action="risk_throttle_0", condition="nowhere", base=" good ", turnover=0.25), changed("elsewhere", event="F", action="entry_gate_skip", condition="all"),
        changed("blank", action="entry_gate_skip", condition=None), changed("a_second", condition="all"),
    ]
    got = judged(spark, rows)
    r = got["throttle"]
    # of two candidates without an action the smaller id is the base
    assert (r.kind, r.base, r.tradable) == ("overlay", "a_second", True) and (r.validation, r.under_stress, r.cost, r.gross_edge) == pytest.approx((5, 10, 2, 7))
    assert (r.edge_x1_0, r.score) == pytest.approx((25, 5))
    assert got["more"].reasons == "edge_cost,turnover"
    assert (got["given"].base, got["given"].validation, got["given"].reasons) == ("good", 0.0, "after_cost,stressed,edge_cost,turnover")
    assert [(got[k].base, got[k].reasons, got[k].score, got[k].gate_has_trades) for k in ("lost", "elsewhere", "blank")] == [("BASE_TEMPLATE::e", "missing_base", 0.0, False), ("BASE_TEMPLATE::f", "missing_base", 0.0, False), ("BASE_TEMPLATE::e", "missing_base", 0.0, False)]


def test_missing_columns_nulls_and_empty(spark):
    bare = spark.createDataFrame([("E", "a"), (None, "b"), ("E", None)], "event string, candidate_id string")
    rows = bridge(bare.withColumns({"cost": bare.event, "tradable": bare.event}), ["event"]).collect()
    assert len(rows) == 3 and all((r.reasons, r.cost, r.edge_to_cost) == ("has_trades,after_cost,stressed,turnover", 0.0, 0.0) for r in rows)
    assert bridge(bare.limit(0), ["event"]).count() == 0


def test_fail_summary(spark):
    rows = [GOOD, changed("few", validation_samples=3), changed("stress", stressed=-0.001), changed("both", validation_samples=3, stressed=-0.001)]
    got = {(r.reason, r.candidates, r.first) for r in fail_summary(bridge(spark.createDataFrame(rows, SHAPE), ["event"]), ["event"]).collect()}
    assert got == {(None, 1, 1), ("has_trades", 2, 2), ("stressed", 2, 1), ("turnover", 2, 0)}
