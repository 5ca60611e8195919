"""What may be traded: exposure shared out among strategies, and candidates judged after costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.allocation import Limits, allocate, allocation_summary
from ..operators.bridge import FACTORS, GATES, bridge, fail_summary
from ..operators.cross import cross_section
from ..operators.regimes import regime_performance, volatility_segments
from . import panel as P
from .queries import oracle_sql, queries, r6, register, s6  # noqa: F401

# --- exposure ------------------------------------------------------------------------------------------------

_LIMITS = Limits(strategy=0.8, symbol=1.6, portfolio=1.2, one_sided=1.3, step=0.25, volatility=0.2, drawdown=0.4, regimes=(("HIGH_VOL", 0.6), ("CHOP", 0.5)), window=96, least=24, bars_a_year=8760.0)
#: Three strategies on each symbol's bars: where they stand, and how much of it is asked for.
_STRATEGIES = {
    "carry": ("coalesce(-sign(funding), 0.0)", "0.5", "hour(ts) % 6 > 0"),
    "fade": ("CASE WHEN round(px_z, 9) > 1 THEN -1.0 WHEN round(px_z, 9) < -1 THEN 1.0 END", "1.0", "hour(ts) % 7 > 0"),
    "trend": ("coalesce(sign(round(trend, 9)), 0.0)", "CASE WHEN hour(ts) % 5 = 0 THEN NULL ELSE 1.25 - hour(ts) / 20.0 END", "true"),
}
_REGIME = "CASE WHEN round(rv_z, 9) > 1 THEN 'HIGH_VOL' WHEN abs(round(px_z, 9)) < 0.3 THEN 'CHOP' WHEN hour(ts) % 2 = 0 THEN 'TREND' END"
_PNL = "CASE WHEN hour(ts) % 11 > 0 THEN round(ret_1, 9) / 500 END"


def _allocated(spark: SparkSession, d: str) -> DataFrame:
    bars = P.features(P.cleaned(spark, d))
    rows = [bars.where(has).select("symbol", "ts", F.lit(n).alias("strategy"), F.expr(pos).cast("double").alias("position"), F.expr(scale).cast("double").alias("scale")) for n, (pos, scale, has) in _STRATEGIES.items()]
    return allocate(reduce(DataFrame.unionByName, rows), ["symbol"], "ts", "strategy", _LIMITS, bars.select("symbol", "ts", F.expr(_PNL).alias("pnl")), bars.select("symbol", "ts", F.expr(_REGIME).alias("regime")))


_WANTED = " UNION ALL ".join(f"SELECT symbol, ts, '{n}' AS strategy, CASE WHEN {has} THEN coalesce({pos}, 0.0) ELSE 0.0 END AS p, CASE WHEN {has} THEN greatest(coalesce({scale}, 0.0), 0.0) ELSE 1.0 END AS scale FROM feat" for n, (pos, scale, has) in _STRATEGIES.items())
_BAR = "OVER (PARTITION BY symbol, ts)"
_ALONG = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
_ALLOCATED_SQL = f"""WITH RECURSIVE {P.features_sql()}, q AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, coalesce({_PNL}, 0) AS pnl, {_REGIME} AS regime FROM feat),
 e AS (SELECT *, product(1 + pnl) {_ALONG} AS equity, CASE WHEN count(*) OVER m >= 24 THEN stddev_samp(pnl) OVER m END AS sd FROM q WINDOW m AS (PARTITION BY symbol ORDER BY ts ROWS 95 PRECEDING)), f AS (SELECT *, max(equity) {_ALONG} AS peak FROM e),
 o AS (SELECT symbol, ts, k, CASE regime WHEN 'HIGH_VOL' THEN 0.6 WHEN 'CHOP' THEN 0.5 ELSE 1 END * coalesce(CASE WHEN sd > 0 THEN least(2, 0.2 / (sd * sqrt(8760.0))) END, 1) * greatest(0, least(1, (0.4 - (peak - equity) / peak) / 0.4)) AS factor FROM f),
 p AS (SELECT *, CAST(p * scale AS DOUBLE) AS requested FROM ({_WANTED})), c1 AS (SELECT *, greatest(-0.8, least(0.8, requested)) AS x FROM p), c2 AS (SELECT * REPLACE (x * least(1, 1.6 / greatest(sum(abs(x)) {_BAR}, 1.6)) AS x) FROM c1),
 c3 AS (SELECT * REPLACE (x * CASE WHEN abs(abs(sum(x) {_BAR}) - sum(abs(x)) {_BAR}) < 1e-9 AND sum(abs(x)) {_BAR} > 1.3 THEN 1.3 / sum(abs(x)) {_BAR} ELSE 1 END AS x) FROM c2), c4 AS (SELECT c3.* REPLACE (x * factor AS x), k FROM c3 JOIN o USING (symbol, ts)),
 c5 AS MATERIALIZED (SELECT * REPLACE (CAST(x * least(1, 1.2 / greatest(sum(abs(x)) {_BAR}, 1.2)) AS DOUBLE) AS x) FROM c4),
 w AS (SELECT symbol, strategy, ts, k, p, requested, greatest(-0.25, least(0.25, x)) AS y FROM c5 WHERE k = 1 UNION ALL SELECT c5.symbol, c5.strategy, c5.ts, c5.k, c5.p, c5.requested, w.y + greatest(-0.25, least(0.25, c5.x - w.y)) FROM w JOIN c5 ON c5.symbol = w.symbol AND c5.strategy = w.strategy AND c5.k = w.k + 1)"""

register("allocated_positions", f"{_ALLOCATED_SQL} SELECT symbol, ts, strategy, {s6('requested')} AS requested, {s6('y')} AS allocated, {s6('coalesce(abs(y) / nullif(abs(p), 0), 0)')} AS scale FROM w")(
    lambda spark, d: _allocated(spark, d).select("symbol", "ts", "strategy", *[r6(F.col(c)).alias(c) for c in ("requested", "allocated", "scale")])
)
register("allocation_clipped", f"{_ALLOCATED_SQL} SELECT symbol, {s6('sum(abs(requested))')} AS requested_gross, {s6('sum(abs(y))')} AS allocated_gross, {s6('greatest(0, 1 - sum(abs(y)) / sum(abs(requested)))')} AS clipped_fraction FROM w GROUP BY 1")(
    lambda spark, d: allocation_summary(_allocated(spark, d), ["symbol"]).select("symbol", *[r6(F.col(c)).alias(c) for c in ("requested_gross", "allocated_gross", "clipped_fraction")])
)

# --- candidates ----------------------------------------------------------------------------------------------

#: Of 24 candidates a type four share a condition: one without an action, two overlays and a delay; the fifth condition has no base.
_CANDIDATES = {
    "candidate_id": "'c' || CAST(u AS VARCHAR)",
    "action": "CASE u % 4 WHEN 0 THEN CASE WHEN u = 16 THEN 'delay_2' ELSE 'no_action' END WHEN 1 THEN 'entry_gate_skip' WHEN 2 THEN 'risk_throttle_0.5' ELSE 'delay_8' END",
    "condition": "CASE WHEN u < 20 THEN 'k' || CAST(u - u % 4 AS VARCHAR) END",
    "after_cost": "(round(mean, 9) - 44) / 2000",
    "stressed": "CASE WHEN u % 7 > 0 THEN (round(mean, 9) - 46) / 2000 END",
    "cost_bps": "CASE WHEN u % 5 > 0 THEN 4.0 + u / 2.0 END",
    "cost_ratio": "u / 20.0",
    "turnover": "CASE WHEN u % 4 = 1 THEN 0.0 WHEN u % 4 = 2 THEN 0.5 ELSE 0.9 + u / 100.0 END",
    "validation_samples": "CASE WHEN u % 9 > 0 THEN n END",
    "samples": "n - 2",
}


def _judged(spark: SparkSession, d: str) -> DataFrame:
    g = P.table(spark, d, "events").groupBy("event_type", F.pmod("user_id", F.lit(24)).alias("u")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    c = g.select("event_type", *[F.expr(text.replace("VARCHAR", "STRING")).alias(n) for n, text in _CANDIDATES.items()])
    return bridge(c, ["event_type"], edge_cost=1.5, least_trades=10)


_JUDGED_SQL = f"""WITH g AS (SELECT event_type, user_id % 24 AS u, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2), c AS (SELECT event_type, {", ".join(f"{text} AS {n}" for n, text in _CANDIDATES.items())} FROM g),
 b AS (SELECT event_type, condition AS k, min(candidate_id) AS base FROM c WHERE action = 'no_action' GROUP BY 1, 2),
 m AS (SELECT c.*, CASE WHEN action IN ('entry_gate_skip', 'risk_throttle_0.5') THEN 'overlay' ELSE 'standalone' END AS kind, coalesce(b.base, 'BASE_TEMPLATE::' || lower(c.event_type)) AS under, CASE WHEN cost_bps > 0 THEN cost_bps * greatest(turnover, 0.1) ELSE abs(after_cost) * 10000 * least(1, cost_ratio) END AS cost, after_cost * 10000 AS v, coalesce(stressed, after_cost) * 10000 AS s, coalesce(validation_samples, samples) AS trades FROM c LEFT JOIN b ON b.event_type = c.event_type AND b.k = c.condition),
 j AS (SELECT m.event_type, m.candidate_id, m.kind, CASE WHEN m.kind = 'overlay' THEN m.under END AS base, m.trades, m.cost, m.v AS own, m.turnover, o.turnover AS base_turnover, m.kind = 'overlay' AND o.candidate_id IS NULL AS lost, m.v - coalesce(o.v, 0) AS validation, m.s - coalesce(o.s, 0) AS under_stress FROM m LEFT JOIN m o ON m.kind = 'overlay' AND o.event_type = m.event_type AND o.candidate_id = m.under),
 t AS (SELECT *, greatest(0, validation + cost) AS gross_edge, NOT lost AND trades >= 10 AS gate_has_trades, NOT lost AND validation > 0 AS gate_after_cost, NOT lost AND under_stress > 0 AS gate_stressed, NOT lost AND greatest(0, validation + cost) >= 1.5 * cost AS gate_edge_cost, NOT lost AND under_stress > 0 AND turnover <= 1 AND (base_turnover IS NULL OR turnover <= base_turnover + 1e-9) AS gate_turnover FROM j),
 r AS (SELECT *, CASE WHEN lost THEN ['missing_base'] ELSE list_filter([{", ".join(f"CASE WHEN NOT gate_{g} THEN '{g}' END" for g in GATES)}], lambda x: x IS NOT NULL) END AS why FROM t)"""

_FIGURES = ("cost", "validation", "under_stress", "gross_edge", "edge_to_cost", *(f"edge_{n}" for n in FACTORS), "score")
register(
    "bridge_candidates",
    f"{_JUDGED_SQL} SELECT event_type, candidate_id, kind, base, trades, {', '.join(f'{s6(t)} AS {n}' for n, t in {'cost': 'cost', 'validation': 'validation', 'under_stress': 'under_stress', 'gross_edge': 'gross_edge', 'edge_to_cost': 'gross_edge / greatest(cost, 1e-9)', **{f'edge_{n}': f'own + {1 - f} * cost' for n, f in FACTORS.items()}, 'score': 'CASE WHEN lost THEN 0 ELSE validation END'}.items())}, {', '.join(f'gate_{g}' for g in GATES)}, len(why) = 0 AS tradable, why[1] AS first_failed, array_to_string(why, ',') AS reasons FROM r",
)(lambda spark, d: _judged(spark, d).select("event_type", "candidate_id", "kind", "base", "trades", *[r6(F.col(c)).alias(c) for c in _FIGURES], *[f"gate_{g}" for g in GATES], "tradable", "first_failed", "reasons"))
register("bridge_fail_reasons", f"{_JUDGED_SQL}, x AS (SELECT event_type, why[1] AS f, unnest(CASE WHEN len(why) = 0 THEN [NULL] ELSE why END) AS reason FROM r) SELECT event_type, reason, count(*) AS candidates, count(*) FILTER (WHERE f IS NOT DISTINCT FROM reason) AS first FROM x GROUP BY 1, 2")(
    lambda spark, d: fail_summary(_judged(spark, d), ["event_type"])
)

# --- cross-sections ------------------------------------------------------------------------------------------

_CROSS = {"cs_mean": "m", "cs_std": "s", "cs_median": "med", "cs_mad": "mad", "cs_z": "(x - m) / (s + 1e-12)", "cs_rank": "k * 1.0 / n"}
# a deviation of nothing but rounding would be blown up by the score, so the robust one is compared where the spread is real
_ROBUST = "CASE WHEN mad > 1e-6 THEN (x - med) / (1.4826 * mad + 1e-12) END"


@register(
    "cross_section_robust",
    f"""WITH {P.features_sql()}, a AS (SELECT symbol, ts, round(trend, 9) AS x FROM feat WHERE trend IS NOT NULL), g AS (SELECT ts, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s, median(x) AS med FROM a GROUP BY 1 HAVING count(*) >= 3),
 d AS (SELECT ts, median(abs(x - med)) AS mad FROM a JOIN g USING (ts) GROUP BY 1), r AS (SELECT *, dense_rank() OVER (PARTITION BY ts ORDER BY x) AS k FROM a)
 SELECT symbol, ts, n, {", ".join(f"{s6(t)} AS {c}" for c, t in _CROSS.items())}, {s6(_ROBUST)} AS cs_robust_z FROM r JOIN g USING (ts) JOIN d USING (ts) WHERE s > 1e-6""",
)
def cross_section_robust(spark: SparkSession, d: str) -> DataFrame:
    """All figures of the cross-section of trends; hours in which all trends are equal have no scores to compare."""
    out = cross_section(P.features(P.cleaned(spark, d)).select("symbol", "ts", F.round("trend", 9).alias("trend")), ["ts"], "trend").where("cs_std > 1e-6")
    return out.select("symbol", "ts", "n", *[r6(F.col(c)).alias(c) for c in _CROSS], F.when(F.col("cs_mad") > 1e-6, r6(F.col("cs_robust_z"))).alias("cs_robust_z"))

# --- profit by regime ------------------------------------------------------------------------------------------

_LABEL = "CASE WHEN round(rv_z, 9) > 0 THEN 'high' WHEN rv_z IS NOT NULL THEN 'low' END"
_PERFORMANCE = ("total", "mean", "sd", "sharpe", "max_drawdown")
_SEGMENTS = ("high", "mid", "low", "share_high")

register(
    "regime_performance",
    f"""WITH {P.features_sql()}, r AS (SELECT symbol, {_LABEL} AS regime, ts, ret_1 AS x FROM feat WHERE ret_1 IS NOT NULL), c AS (SELECT *, sum(x) OVER w AS cum FROM r WINDOW w AS (PARTITION BY symbol, regime ORDER BY ts ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, max(cum) OVER w - cum AS fall FROM c WINDOW w AS (PARTITION BY symbol, regime ORDER BY ts ROWS UNBOUNDED PRECEDING))
 SELECT symbol, regime, count(*) AS n, {s6('sum(x)')} AS total, {s6('avg(x)')} AS mean, {s6('stddev_samp(x)')} AS sd, {s6('coalesce(avg(x) / nullif(stddev_samp(x), 0), 0)')} AS sharpe, {s6('max(fall)')} AS max_drawdown FROM f GROUP BY 1, 2""",
)(lambda spark, d: regime_performance(P.features(P.cleaned(spark, d)).select("symbol", F.expr(_LABEL).alias("regime"), "ts", "ret_1"), ["symbol", "regime"], "ts", "ret_1", 7).select("symbol", "regime", "n", *[r6(F.col(c)).alias(c) for c in _PERFORMANCE]))
register(
    "regime_segmentation",
    f"""WITH {P.features_sql()}, r AS (SELECT symbol, ret_1 AS x, round(rv, 9) AS v FROM feat WHERE ret_1 IS NOT NULL AND rv IS NOT NULL), q AS (SELECT symbol, quantile_cont(v, 0.75) AS hi, quantile_cont(v, 0.25) AS lo FROM r GROUP BY 1)
 SELECT symbol, {s6('coalesce(avg(x) FILTER (WHERE v >= hi), 0) * 8760')} AS high, {s6('coalesce(avg(x) FILTER (WHERE v > lo AND v < hi), 0) * 8760')} AS mid, {s6('coalesce(avg(x) FILTER (WHERE v <= lo), 0) * 8760')} AS low, {s6('count(*) FILTER (WHERE v >= hi) / count(*)')} AS share_high FROM r JOIN q USING (symbol) GROUP BY 1""",
)(lambda spark, d: volatility_segments(P.features(P.cleaned(spark, d)).select("symbol", "ret_1", F.round("rv", 9).alias("rv")), ["symbol"], "ret_1", "rv", bars_a_year=8760.0).select("symbol", *[r6(F.col(c)).alias(c) for c in _SEGMENTS]))
