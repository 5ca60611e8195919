"""Candidates from events: costs of their trades, tests by split, and promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import CostModel, Promotion, candidate_costs, promote, split_tests
from . import panel as P
from .queries import _splits, oracle_sql, queries, r6, register, s6  # noqa: F401

# --- costs -----------------------------------------------------------------------------------------------

_ACTIONS = "CASE (day(ts) % 4) WHEN 0 THEN 'no_action' WHEN 1 THEN 'entry_gate_skip' WHEN 2 THEN 'risk_throttle_0.5' ELSE 'delay_3' END"
_MODEL = CostModel(least_coverage=0.5, most_participation=0.001)
_TRADES = f"t AS (SELECT symbol, {_ACTIONS} AS action, spread_z AS spread_bps, CASE WHEN hour(ts) % 5 > 0 THEN bar_range * close / 100 END AS atr, quote_volume, close * 100 AS close, close * 100 + bar_range AS high, close * 100 - bar_range AS low, CASE WHEN hour(ts) % 3 = 0 THEN 0.2 ELSE 0.9 END AS tob_coverage FROM feat WHERE spread_z > 0.5)"
register(
    "cost_candidate",
    f"""WITH {P.features_sql()}, {_TRADES}, e AS (SELECT *, 0.0004 * (1 + length(symbol) % 3) AS expectancy, CASE WHEN action = 'entry_gate_skip' THEN 0.0 WHEN action = 'risk_throttle_0.5' THEN 0.5 ELSE 1.0 END AS turn, greatest(coalesce(nullif(quote_volume, 0), 1e6), 1) AS avail FROM t),
 m AS (SELECT symbol, action, max(1 / avail) AS scarce FROM e GROUP BY 1, 2), c AS (SELECT e.*, greatest(0, least(150, 4 + CASE WHEN tob_coverage >= 0.5 THEN 0.5 * spread_bps + 0.1 * abs(coalesce(atr / close * 10000, (high - low) / close * 10000, 0)) + (1 / avail) / scarce + 0.1 * (10 * sqrt(turn / avail) + 50 * (exp(greatest(0, least(5, (turn / avail - 0.001) / 0.001))) - 1)) ELSE 2 END)) AS cost FROM e JOIN m USING (symbol, action)),
 g AS (SELECT symbol, action, any_value(expectancy) AS x, count(*) AS n, avg(turn) AS turnover, avg(cost) AS cost_bps, greatest(avg(cost * turn) / 10000, 0) AS per, (count(spread_bps) + count(quote_volume) + count(close) + count(high) + count(low)) / (5.0 * count(*)) AS coverage FROM c GROUP BY 1, 2)
 SELECT symbol, action, n, {s6('turnover')} AS turnover, {s6('cost_bps')} AS cost_bps, {s6('coverage')} AS coverage, {s6('x - per')} AS after_cost, {s6('x - 1.5 * per')} AS stressed, {s6('least(2, per / greatest(1e-9, abs(x) + per))')} AS cost_ratio, x - per > 0 AS gate_after_cost, x - 1.5 * per > 0 AS gate_stressed, coverage >= 0.8 AS gate_model, least(2, per / greatest(1e-9, abs(x) + per)) < 0.6 AS gate_ratio FROM g""",
)(lambda spark, d: _costs(P.features(P.cleaned(spark, d)).where("spread_z > 0.5")))


def _costs(bars: DataFrame) -> DataFrame:
    """Four actions on each symbol's wide bars."""
    trades = bars.select(
        "symbol", F.expr(_ACTIONS).alias("action"), F.col("spread_z").alias("spread_bps"), F.expr("CASE WHEN hour(ts) % 5 > 0 THEN bar_range * close / 100 END").alias("atr"), "quote_volume", (F.col("close") * 100).alias("close"), (F.col("close") * 100 + F.col("bar_range")).alias("high"), (F.col("close") * 100 - F.col("bar_range")).alias("low"),
        F.expr("CASE WHEN hour(ts) % 3 = 0 THEN 0.2D ELSE 0.9D END").alias("tob_coverage"), (0.0004 * (1 + F.length("symbol") % 3)).alias("expectancy"),
    )
    out = candidate_costs(trades, ["symbol", "action"], "expectancy", _MODEL)
    return out.withColumns({c: r6(F.col(c)) for c in ("turnover", "cost_bps", "coverage", "after_cost", "stressed", "cost_ratio")})


# --- tests by split --------------------------------------------------------------------------------------

_SPLIT = "b AS (SELECT min(ts) AS a, max(ts) AS z FROM events), s AS (SELECT e.*, CASE WHEN epoch_us(ts) < epoch_us(a) + (epoch_us(z) - epoch_us(a)) * 0.6 THEN 'train' WHEN epoch_us(ts) < epoch_us(a) + (epoch_us(z) - epoch_us(a)) * 0.8 THEN 'validation' ELSE 'test' END AS split_label FROM events e, b)"
_PARTS = ("train", "validation", "test")
_T = lambda s: f"avg(value - 50) FILTER (WHERE split_label = '{s}') / (nullif(stddev_samp(value - 50) FILTER (WHERE split_label = '{s}'), 0) / sqrt(count(value) FILTER (WHERE split_label = '{s}')))"


def _tests(spark: SparkSession, d: str) -> DataFrame:
    e = P.table(spark, d, "events")
    rows = e.join(_splits(e), "event_id").select("event_type", (F.col("user_id") % 12).alias("rule"), "split_label", (F.col("value") - 50).alias("x"))
    return split_tests(rows, ["event_type", "rule"], "split_label", "x", list(_PARTS))


register(
    "split_t",
    f"WITH {_SPLIT} SELECT event_type, user_id % 12 AS rule, " + ", ".join(f"count(value) FILTER (WHERE split_label = '{s}') AS {s}_n, {s6(_T(s))} AS {s}_t" for s in _PARTS) + " FROM s GROUP BY 1, 2",
)(lambda spark, d: _tests(spark, d).select("event_type", "rule", *[c for s in _PARTS for c in (F.col(f"{s}_n"), r6(F.col(f"{s}_t")).alias(f"{s}_t"))]))
#: The normal p has no statement; a test compares it with the error function.
register("split_t_p")(lambda spark, d: _tests(spark, d).select("event_type", "rule", *[r6(F.col(f"{s}_p")).alias(f"{s}_p") for s in _PARTS]))

# --- promotion -------------------------------------------------------------------------------------------

_RULE = Promotion(least_events=20, least_stability=0.02, most_control_rate=0.2025, require_audit=True)


@register(
    "promote_gates",
    f"""WITH {_SPLIT}, c AS (SELECT event_type, user_id % 12 AS rule, count(*) AS n, round(avg(value) - 34, 9) AS effect, stddev_samp(value) AS sd, (sum(event_id) % 40) / 200.0 AS q, sum(event_id) % 7 AS h, {_T('validation')} AS v, {_T('test')} AS t, avg(CASE WHEN user_id % 2 = 0 THEN 0.9 ELSE 0.5 END) AS tob, count(*) FILTER (WHERE split_label = 'validation') AS vs FROM s GROUP BY 1, 2),
 k AS (SELECT event_type, avg(CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE 0.0 END) AS rate FROM events WHERE event_type <> 'view' GROUP BY 1), u AS (SELECT c.*, coalesce(k.rate, 0.25) AS rate, CASE WHEN v IS NULL AND t IS NULL THEN CASE WHEN h <> 1 THEN 1.0 ELSE 0.0 END ELSE (coalesce(CAST((v >= 0) = (effect >= 0) AS INT), 0) + coalesce(CAST((t >= 0) = (effect >= 0) AS INT), 0)) * 1.0 / (CAST(v IS NOT NULL AS INT) + CAST(t IS NOT NULL AS INT)) END AS sign, (2.0 + CAST(h > 2 AS INT) + CAST(h > 4 AS INT)) / 4 AS cost FROM c LEFT JOIN k USING (event_type)),
 w AS (SELECT *, sign * abs(effect) / greatest(abs(coalesce(sd, 0)), 1e-8) AS stab FROM u), g AS (SELECT *, list_filter([CASE WHEN q > 0.1 THEN 'statistical_q_value' END, CASE WHEN n < 20 THEN 'statistical_min_events' END, CASE WHEN h = 1 THEN 'stability_gate' END, CASE WHEN stab < 0.02 THEN 'stability_score' END, CASE WHEN sign < 0.67 THEN 'stability_sign_consistency' END, CASE WHEN cost < 0.75 THEN 'cost_survival' END, CASE WHEN rate > 0.2025 THEN 'negative_control_fail' END,
  CASE WHEN h = 3 THEN 'hypothesis_not_executed' END, CASE WHEN h = 5 THEN 'hypothesis_missing_audit' END, CASE WHEN h = 6 THEN 'hypothesis_missing_plan_row_id' END, CASE WHEN vs <= 0 THEN 'no_validation_samples' END], lambda x: x IS NOT NULL) AS r FROM w),
 f AS (SELECT *, NOT list_has_any(r, ['statistical_q_value', 'statistical_min_events']) AS g1, NOT list_has_any(r, ['stability_gate', 'stability_score', 'stability_sign_consistency']) AS g2, cost >= 0.75 AS g3, rate <= 0.2025 AS g4, NOT list_has_any(r, ['hypothesis_not_executed', 'hypothesis_missing_audit', 'hypothesis_missing_plan_row_id']) AS g5, tob >= 0.6 AS g6, vs > 0 AS g7 FROM g)
 SELECT event_type || '|' || rule AS candidate_id, len(r) = 0 AS promoted, CASE WHEN len(r) = 0 AND g6 THEN 'standard' ELSE 'fallback_only' END AS track, {s6('(CAST(g1 AS INT) + CAST(g2 AS INT) + CAST(g3 AS INT) + CAST(g4 AS INT) + CAST(g6 AS INT) + CAST(g7 AS INT)) / 6.0')} AS score, {s6('sign')} AS sign_consistency, {s6('stab')} AS stability, {s6('rate')} AS control_rate, g1 AS gate_statistical, g2 AS gate_stable, g3 AS gate_cost, g4 AS gate_control, g5 AS gate_audit, r[1] AS first_failed, array_to_string(list_sort(r), '|') AS reasons FROM f""",
)
def promote_gates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by type and rule through all gates, with an audit that lacks some and control rates that lack one type."""
    e = P.table(spark, d, "events")
    tests = _tests(spark, d).select("event_type", "rule", "validation_t", "test_t", "validation_n")
    rows = e.join(_splits(e), "event_id")
    v = F.count_if(F.col("split_label") == "validation")
    base = rows.groupBy("event_type", (F.col("user_id") % 12).alias("rule")).agg(
        F.count("*").alias("n_events"), F.round(F.avg("value") - 34, 9).alias("effect"), F.stddev_samp("value").alias("std"), ((F.sum("event_id") % 40) / 200.0).alias("q_value"), (F.sum("event_id") % 7).alias("h"), F.avg(F.when(F.col("user_id") % 2 == 0, 0.9).otherwise(0.5)).alias("tob_coverage"), v.alias("validation_samples")
    )
    h, name = F.col("h"), F.concat_ws("|", "event_type", F.col("rule").cast("string"))
    c = base.join(tests, ["event_type", "rule"]).withColumns(
        {"candidate_id": name, "plan_row_id": F.when(h == 6, "").otherwise(name), "gate_stability": h != 1, "gate_delay": F.lit(None).cast("boolean"), "t_values": F.array("validation_t", "test_t"), "cost_gates": F.array(F.lit(True), F.lit(True), h > 2, h > 4)}
    )
    audit = c.where("h <> 5").select("plan_row_id", (h != 3).alias("executed")).where("plan_row_id <> ''")
    rates = e.where("event_type <> 'view'").groupBy("event_type").agg(F.avg(F.when(F.col("event_id") % 5 == 0, 1.0).otherwise(0.0)).alias("rate"))
    controls = rates.unionByName(spark.createDataFrame([(None, 0.25)], "event_type string, rate double"))
    out = promote(c, audit, controls, _RULE)
    return out.select("candidate_id", "promoted", "track", *[r6(F.col(x)).alias(x) for x in ("score", "sign_consistency", "stability", "control_rate")], "gate_statistical", "gate_stable", "gate_cost", "gate_control", "gate_audit", "first_failed", "reasons")
