"""Operators on small hand-made frames."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.tails import student_tail
from tidemark.operators.align import active_on_grid, asof_join, grid_reindex, own_rows, runs, time_chunks
from tidemark.operators.greedy import cool_down, space_out
from tidemark.operators.pooling import newey_west, pool, unit_moments
from tidemark.operators.testing import bh_adjust
from tidemark.plans import panel, queries, study
from tidemark.plans.detectors import RULES
from tidemark.sources.readers import parse_funding, parse_klines, parse_liquidations, parse_quotes
from tidemark.streaming.streams import stream_dedupe

SF = "/root/testdata/sf0.001"

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_asof_keeps_rows_and_takes_null_values(spark):
    left = spark.createDataFrame([("a", at(0), 1), ("a", at(7), 2), ("b", at(7), 3)], "symbol string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("a", at(5), 1.5), ("a", at(6), None), ("c", at(1), 9.0)], "symbol string, ts timestamp_ntz, v double")
    got = {r.id: (r.v, r.matched_ts) for r in asof_join(left, right, ["symbol"]).collect()}
    assert got == {1: (None, None), 2: (None, at(6)), 3: (None, None)}
    got = {r.id: r.matched_ts for r in asof_join(left, right, ["symbol"], tolerance=F.expr("interval 30 seconds")).collect()}
    assert got == {1: None, 2: None, 3: None}


def test_asof_forward_and_strict(spark):
    left = spark.createDataFrame([("a", at(5), 1)], "symbol string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("a", at(5), 1.0), ("a", at(9), 2.0)], "symbol string, ts timestamp_ntz, v double")
    assert asof_join(left, right, ["symbol"], forward=True).first().v == 1.0
    assert asof_join(left, right, ["symbol"], forward=True, strict=True).first().v == 2.0
    assert asof_join(left, right.limit(0), ["symbol"]).first().v is None


def test_grid_and_runs(spark):
    df = spark.createDataFrame([("a", at(0), 1.0), ("a", at(15), 2.0)], "symbol string, ts timestamp_ntz, close double")
    grid = grid_reindex(df, ["symbol"], "5 minutes")
    assert [r.run_length for r in runs(grid, F.col("close").isNull(), ["symbol"]).orderBy("ts").collect()] == [1, 2, 2, 1]


def test_active_bounds_are_inclusive(spark):
    grid = spark.createDataFrame([("a", at(m)) for m in range(0, 30, 5)], "symbol string, ts timestamp_ntz")
    spans = spark.createDataFrame([("a", at(5), at(15)), ("a", at(10), at(15))], "symbol string, enter_ts timestamp_ntz, exit_ts timestamp_ntz")
    assert [r.active for r in active_on_grid(grid, spans, ["symbol"]).orderBy("ts").collect()] == [False, True, True, True, False, False]


@pytest.mark.parametrize("gap", [1, 3, 7])
def test_spacing_is_the_sequential_rule(spark, gap):
    hits = [(k, (i * i * 7 + k * 3) % 97) for k in range(3) for i in range(20)]
    hits = sorted(set(hits))
    want = []
    for k in range(3):
        last = None
        for i in sorted(i for s, i in hits if s == k):
            if last is None or i - last >= gap:
                want.append((k, i))
                last = i
    df = spark.createDataFrame(hits, "symbol int, bar long").repartition(5)
    assert sorted(map(tuple, space_out(df, ["symbol"], "bar", gap).collect())) == want


def test_cooldown_is_the_sequential_rule(spark):
    spans = [("a", i, i + (i * 5) % 9) for i in range(0, 100, 2)]
    want, reach = [], -1
    for s, a, b in spans:
        if a > reach:
            want.append((s, a, b))
            reach = b + 4
    df = spark.createDataFrame(spans, "symbol string, bar long, leave long")
    assert sorted(map(tuple, cool_down(df, ["symbol"], "bar", "leave", 4).collect())) == want


def test_bh(spark):
    p = [0.9, 0.004, 0.02, 0.02, 0.3, 0.0001, 0.07]
    ordered = sorted(p)
    # the smallest p * m / rank among values that are not smaller; ties take their highest rank
    want = {x: min(1.0, *(y * len(p) / (max(i for i, z in enumerate(ordered) if z == y) + 1) for y in p if y >= x)) for x in p}
    got = {r.p: r.q for r in bh_adjust(spark.createDataFrame([(x,) for x in p], "p double"), "p", "q", []).collect()}
    assert got == pytest.approx(want)


def test_student_tail():
    assert student_tail(0, 5) == pytest.approx(0.5)
    assert student_tail(2.015, 5) == pytest.approx(0.05, abs=1e-4)
    assert student_tail(1.96, 1e7) == pytest.approx(0.5 * math.erfc(1.96 / math.sqrt(2)), abs=1e-5)


def test_chunks_keep_each_row_once(spark):
    df = spark.createDataFrame([("a", at(60 * i), float(i)) for i in range(100)], "symbol string, ts timestamp_ntz, x double").repartition(7)
    cut = time_chunks(df, 3600, 16, 10, 3)
    assert sorted(own_rows(cut).collect()) == sorted(df.collect()) and cut.count() > 100
    with pytest.raises(ValueError):
        time_chunks(df, 3600, 8, 10, 3)


def test_small_chunks_change_no_feature_and_no_hit(spark):
    bars = panel.cleaned(spark, SF).where("symbol = 'click'")
    cols = ["symbol", "ts", *[F.round(c, 9).alias(c) for c in ("rv_z", "range_base", "roll_spread", "broke_before", "score")]]
    whole, cut = panel.features(bars).select(*cols), panel.features(bars, chunk=panel.BEFORE).select(*cols)
    assert whole.exceptAll(cut).count() == 0 and whole.count() == cut.count()
    few, many = queries.hits(spark, SF, panel.BEFORE).drop("fwd"), queries.hits(spark, SF).drop("fwd")
    assert few.exceptAll(many).count() == 0 and few.count() == many.count()


def hit(spark, rule, **values):
    """Whether a rule of the detectors holds for a row of these values."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(F.coalesce(F.expr(RULES[rule][0]), F.lit(False)).alias("x")).first().x


def test_rules_on_single_rows(spark):
    thin = dict(quote_volume=40.0, vol_base=100.0, range_base=0.1)
    assert hit(spark, "LIQUIDITY_SHOCK", bar_range=0.21, **thin) and not hit(spark, "LIQUIDITY_SHOCK", bar_range=0.19, **thin)
    trend = dict(abs_trend=0.9, abs_trend_pq700=0.5, trend_step=0.4, trend_step_pq900=0.3, trend=0.9)
    assert hit(spark, "TREND_ACCELERATION", ret_mean_3=0.1, **trend) and not hit(spark, "TREND_ACCELERATION", ret_mean_3=-0.1, **trend)
    down = dict(prev_abs_trend=0.9, prev_abs_trend_pq700=0.5, trend_step=-0.4, trend_step_pq100=-0.3, prev_trend=0.9)
    assert hit(spark, "TREND_DECELERATION", ret_1=0.0, **down) and not hit(spark, "TREND_DECELERATION", ret_1=0.1, **down)
    false = dict(close=5.0, prev_high=6.0, prev_low=4.0, abs_ret=0.2, abs_ret_pq400=0.1)
    assert hit(spark, "FALSE_BREAKOUT", broke_before=1, **false) and not hit(spark, "FALSE_BREAKOUT", broke_before=0, **false)
    assert hit(spark, "SUPPORT_RESISTANCE_BREAK", close=9.0, top_48=8.0, bottom_48=1.0, rv=0.5, rv_pq600=0.4) and not hit(spark, "SUPPORT_RESISTANCE_BREAK", close=7.0, top_48=8.0, bottom_48=1.0, rv=0.5, rv_pq600=0.4)
    assert hit(spark, "SESSION_CLOSE_EVENT", hh=7, mm=0) and not hit(spark, "SESSION_CLOSE_EVENT", hh=8, mm=0)


def test_pooling_pulls_small_units_harder_and_counts_equal_effects(spark):
    rows = [("f", "s", 1, 10, 0.1, 0.02), ("f", "s", 2, 500, 0.02, 0.02), ("f", "s", 3, 700, 0.02, 0.02), ("f", "t", 4, 300, 0.05, 0.02)]
    df = spark.createDataFrame(rows, "family string, state string, unit int, n long, effect double, sd double")
    got = {r.unit: r for r in pool(df, [["family"], ["family", "state"]]).collect()}
    assert got[1].weight < got[2].weight < got[3].weight and got[4]["lambda"] == 5000.0 and got[2]["lambda"] < 5000.0
    assert 0.02 < got[1].pooled < 0.1
    m = {r.state: r for r in unit_moments(df, ["family", "state"]).collect()}["s"]
    mu = (10 * 0.1 + 1200 * 0.02) / 1210
    assert m.mean == pytest.approx(mu) and m["var"] == pytest.approx((1207 * 0.0004 + 10 * (0.1 - mu) ** 2 + 1200 * (0.02 - mu) ** 2) / 1209)


def test_hac_by_hand(spark):
    import numpy as np

    x = np.cumsum(np.random.default_rng(1).normal(size=150)) / 10
    r, lags = x - x.mean(), int(4 * (150 / 100) ** (2 / 9))
    lrv = (r * r).mean() + sum(2 * (1 - k / (lags + 1)) * (r[k:] * r[:-k]).sum() / 150 for k in range(1, lags + 1))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "symbol string, ts int, x double").repartition(3)
    assert newey_west(df, ["symbol"], "x", "ts").first().t_hac == pytest.approx(x.mean() / np.sqrt(lrv / 150))


def test_sharpe_and_p_values_by_hand(spark):
    from statistics import NormalDist

    cdf = NormalDist().cdf
    z = {r.symbol: r for r in study.queries()["psr_dsr_moments"](spark, SF).collect()}
    got = study.psr_dsr(spark, SF).collect()
    assert got and all(r.psr == pytest.approx(cdf(z[r.symbol].z), abs=2e-6) and r.dsr < r.psr for r in got)
    tests = queries.expectancy_p_values(spark, SF).collect()
    known = {r.event_type: r.t_stat for r in queries.study(spark, SF).collect()}
    assert tests and all(r.p_value == pytest.approx(2 * cdf(-abs(known[r.event_type]))) and r.q_value >= r.p_value and r.simes_p >= 0 for r in tests)


def test_raw_layouts(spark):
    strings = lambda names, *rows: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    bars = strings("open_time open high low close volume quote_volume taker_base_volume", ("open_time",) * 8, ("1704067200000", "1", "2", "0.5", "1.5", "9", "12", "3"), ("1704067200000", "1", "2", "0.5", "NaN", "9", "12", "3"))
    assert [(r.ts, r.close) for r in parse_klines(bars, F.lit("a")).collect()] == [(T0, 1.5)]
    rates = strings("calc_time rate", ("1704067201", "0.0001"), ("1704096000", "0.0002"), ("x", "1"))
    assert [(r.ts, r.funding_rate) for r in parse_funding(rates, F.lit("a"), F.lit("f")).orderBy("ts").collect()] == [(T0, 0.0001), (at(480), 0.0002)]
    quotes = strings("best_bid_price best_bid_qty best_ask_price best_ask_qty transaction_time event_time", ("1", "2", "3", "4", "1704067200000", "5"), ("1", "2", None, "4", "1704067200000", "5"), ("1", "2", "3", "4", None, "1704067260000"))
    assert [r.ts for r in parse_quotes(quotes, F.lit("a")).orderBy("ts").collect()] == [T0, at(1)]
    sold = strings("time side price quantity", ("1704067200", "sell", "2", "3"), ("1704067200000", "S", "2", "3"), ("1704067200", "?", "2", "3"))
    assert [(r.ts, r.side, r.notional) for r in parse_liquidations(sold, F.lit("a")).collect()] == [(T0, "SELL", 6.0)]


def test_stream_keeps_the_first_of_each_key(spark, tmp_path):
    rows = [(1, at(0)), (1, at(5)), (2, at(6)), (2, at(6))]
    spark.createDataFrame(rows, "user_id int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_dedupe(spark.readStream.schema("user_id int, ts timestamp").parquet(str(tmp_path / "in")), ["user_id"], "1 day")
    assert sorted(r.user_id for r in queries._drained(spark, stream, "t").collect()) == [1, 2]
