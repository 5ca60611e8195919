"""Volatility shocks and liquidity vacuums with all their metrics, and the choice of a vacuum's threshold.

Bars are (symbol, ts, bar, n_bars, ...) with bars numbered from 1. What looks back a fixed number of bars runs in time chunks;
ends of episodes come from forward as-of joins, the choice of episodes from the greedy cool-down, and metrics from the bars
that lie within each episode or its horizon.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import ratio, rolling
from ..functions.order_windows import OrderStat, add_level
from ..operators.align import asof_join, own_rows, time_chunks
from ..operators.greedy import cool_down
from ..operators.lineage import durable
from ..operators.ranking import drawn, nearest
from ..operators.spans import rows_within
from . import panel as P
from .episodes import cooled_sql
from .queries import oracle_sql, queries, r6, register, s6  # noqa: F401

KEYS = P.KEYS


def r9(c: Column) -> Column:
    return F.round(c, 9)


def in_chunks(bars: DataFrame, before: int, *levels) -> DataFrame:
    """Levels of columns over a panel cut into chunks that look back `before` bars; each level is a function that makes them."""
    df = time_chunks(bars, P.STEP_MINUTES * 60, max(P.CHUNK, before), before, 0)
    for level in levels:
        df = add_level(df, level(), KEYS)
    return own_rows(df)


def trailing(value: Column, aggregate, rows: int, least: int | None) -> Column:
    return rolling(value, aggregate, rows, least, keys=KEYS)


def before(x: str, n: int = 1) -> Column:
    return F.lag(x, n).over(P.W())


def first_from(spans: DataFrame, bars: DataFrame, condition: Column, start: Column, name: str) -> DataFrame:
    """Adds `name`: the first bar of the symbol at `start` or later that meets the condition."""
    marks = bars.where(condition).select("symbol", F.col("bar").alias("_from"), F.col("bar").alias(name))
    return asof_join(spans.withColumn("_from", start.cast("long")), marks, ["symbol"], on="_from", columns=[name], forward=True, right_time="_found").drop("_from", "_found")


# --- volatility shocks -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class VolShock:
    """Windows in bars; `least_*` values must be there (all of the window, unless given)."""

    rv_window: int = 12
    base_window: int = 288
    shock_quantile: float = 0.99
    relax: float = 1.25
    relax_bars: int = 3
    cooldown: int = 12
    post: int = 96
    auc: int = 96
    least_rv: int | None = None
    least_base: int | None = None


def vol_shock_core(bars: DataFrame, rule: VolShock = VolShock()) -> DataFrame:
    """Bars with logret, rv, rv_base, shock (their ratio), the bar before's, and whether the last bars were all calm."""
    calm = F.when(F.col("shock") <= rule.relax, 1).otherwise(0)
    return in_chunks(
        bars,
        rule.rv_window + rule.base_window + rule.relax_bars + 1,
        lambda: {"logret": F.log("close") - F.log(before("close"))},
        lambda: {"rv": F.sqrt(trailing(F.col("logret") * F.col("logret"), F.avg, rule.rv_window, rule.least_rv))},
        lambda: {"rv_base": OrderStat("quantile", "rv", rule.base_window, rule.least_base or rule.base_window)},
        lambda: {"shock": r9(ratio(F.col("rv"), F.col("rv_base")))},
        lambda: {"was": before("shock"), "calm": F.sum(calm).over(P.W().rowsBetween(1 - rule.relax_bars, 0)) == rule.relax_bars},
    )


def vol_shocks(bars: DataFrame, rule: VolShock = VolShock()) -> DataFrame:
    """Episodes from an onset of the shock ratio at the symbol's quantile to the last of `relax_bars` calm bars in a row (or
    the last bar), each more than `cooldown` bars after the one before, with their metrics.

    Symbols without a ratio have none; a metric without values is null.
    """
    core = durable(vol_shock_core(bars, rule).select("symbol", "ts", "bar", "n_bars", "close", "high", "low", "logret", "rv", "rv_base", "shock", "was", "calm"))
    limits = core.groupBy("symbol").agg(r9(F.percentile("shock", F.lit(rule.shock_quantile))).alias("limit_"))
    onset = core.join(limits, "symbol").where((F.col("shock") >= F.col("limit_")) & (F.col("was") < F.col("limit_")))
    spans = onset.select("symbol", "bar", "n_bars", "limit_", "ts", F.col("rv_base").alias("base"), F.col("close").alias("close_enter"))
    spans = first_from(spans, core, F.col("calm"), F.col("bar") + rule.relax_bars - 1, "leave").withColumn("leave", F.coalesce("leave", "n_bars"))
    kept = cool_down(spans, ["symbol"], "bar", "leave", rule.cooldown)
    path = core.select("symbol", F.col("bar").alias("at"), "rv", "shock", "logret", "high", "low")
    inside = rows_within(path.where("rv is not null").select("symbol", "at", "rv"), kept.select("symbol", "bar", "leave"), ["symbol"], "at", "bar", "leave")
    peaks = inside.groupBy("symbol", "bar").agg(F.max("rv").alias("rv_peak"), F.min_by("at", F.struct(-F.col("rv"), F.col("at"))).alias("peak_at"))
    known = kept.join(peaks, ["symbol", "bar"], "left").withColumns({"half": F.col("base") + 0.5 * (F.col("rv_peak") - F.col("base")), "until": F.greatest("leave", F.col("bar") + max(rule.post, rule.auc))})
    at, start = F.col("at"), F.col("bar")
    post, n = at <= start + rule.post, F.count(F.when(at <= start + rule.post, F.col("logret")))
    returns = F.when(post, F.col("logret"))
    # the sums of the population, corrected for the number of values
    skew = F.when(n >= 3, F.when(F.var_pop(returns) == 0, 0.0).otherwise(F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(returns)))
    kurtosis = F.when(n >= 4, F.when(F.var_pop(returns) == 0, 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(returns) + 6)))
    keys = ["symbol", "bar", "leave", "ts", "n_bars", "rv_peak", "peak_at", "base", "close_enter"]
    told = rows_within(path, known, ["symbol"], "at", "bar", "until").groupBy(*keys).agg(
        (F.min(F.when((at < start + rule.post) & (F.col("rv") <= F.col("half")), at)) - F.first("bar")).alias("half_life"),
        F.sum(F.when((at <= start + rule.auc) & (F.col("rv") > F.col("base")), F.col("rv") - F.col("base")).otherwise(0.0)).alias("auc_excess"),
        (F.min(F.when((at > F.col("peak_at")) & (at <= F.least("leave", start + rule.post)) & (F.col("shock") >= F.col("limit_")), at)) - F.first("bar")).alias("time_to_secondary"),
        F.avg(F.when(post, F.col("rv"))).alias("rv_mean"),
        F.percentile(F.when(post, F.col("rv")), F.lit(0.9)).alias("rv_p90"),
        ((F.max(F.when(post, F.col("high"))) - F.min(F.when(post, F.col("low")))) / F.when(F.first("close_enter") > 0, F.first("close_enter"))).alias("range_pct"),
        skew.alias("skew"),
        kurtosis.alias("kurtosis"),
    )
    return told.select(
        "symbol", F.col("bar").alias("enter_bar"), F.col("leave").alias("exit_bar"), F.col("ts").alias("enter_ts"), (F.col("leave") - start + 1).alias("duration"), (F.col("leave") - start).alias("time_to_relax"), "rv_peak",
        (F.col("peak_at") - start).alias("t_rv_peak"), F.col("base").alias("rv_base"), "half_life", "auc_excess", F.col("time_to_secondary").isNotNull().alias("secondary"), "time_to_secondary", "rv_mean", "rv_p90", "range_pct",
        (F.col("leave") - start <= rule.post).alias("relaxed"), "skew", "kurtosis",
    )


#: Bars of the events table are hourly and have gaps, so the windows need not be full; the rest is as above.
_SHOCK = VolShock(least_rv=4, least_base=48, shock_quantile=0.97)
_SHOCK_SQL = f"""{P.CLEANED_SQL}, l AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS logret, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar, count(*) OVER (PARTITION BY symbol) AS n_bars FROM cleaned),
 v AS (SELECT *, CASE WHEN count(logret) {P.over(12)} >= 4 THEN sqrt(avg(logret * logret) {P.over(12)}) END AS rv FROM l), m AS (SELECT *, CASE WHEN count(rv) {P.over(288)} >= 48 THEN median(rv) {P.over(288)} END AS rv_base FROM v),
 c AS (SELECT *, round(rv / nullif(rv_base, 0), 9) AS shock FROM m), b AS (SELECT c.*, lag(shock) OVER (PARTITION BY symbol ORDER BY ts) AS was, count(*) FILTER (WHERE shock <= 1.25) {P.over(3)} = 3 AS calm, round(quantile_cont(shock, 0.97) OVER (PARTITION BY symbol), 9) AS limit_ FROM c),
 spans AS (SELECT symbol, bar, coalesce((SELECT min(x.bar) FROM b x WHERE x.symbol = b.symbol AND x.bar >= b.bar + 2 AND x.calm), n_bars) AS leave FROM b WHERE shock >= limit_ AND was < limit_), {cooled_sql(12)},
 e AS (SELECT b.symbol, b.bar, b.ts, s.leave, b.n_bars, b.limit_, b.rv_base AS base, b.close AS close_enter FROM kept k JOIN spans s USING (symbol, bar) JOIN b USING (symbol, bar)),
 p AS (SELECT e.*, (SELECT max(b.rv) FROM b WHERE b.symbol = e.symbol AND b.bar BETWEEN e.bar AND e.leave) AS rv_peak FROM e),
 q AS (SELECT p.*, (SELECT min(b.bar) FROM b WHERE b.symbol = p.symbol AND b.bar BETWEEN p.bar AND p.leave AND b.rv = p.rv_peak) AS peak_at FROM p)"""
register(
    "vol_shock_metrics",
    f"""WITH RECURSIVE {_SHOCK_SQL}, w AS (SELECT q.symbol, q.bar, q.ts, q.leave, q.rv_peak, q.peak_at, q.base, min(b.bar) FILTER (WHERE b.bar < q.bar + 96 AND b.rv <= q.base + 0.5 * (q.rv_peak - q.base)) - q.bar AS half_life,
 coalesce(sum(b.rv - q.base) FILTER (WHERE b.bar <= q.bar + 96 AND b.rv > q.base), 0) AS auc_excess, min(b.bar) FILTER (WHERE b.bar > q.peak_at AND b.bar <= least(q.leave, q.bar + 96) AND b.shock >= q.limit_) - q.bar AS second,
 avg(b.rv) FILTER (WHERE b.bar <= q.bar + 96) AS rv_mean, quantile_cont(b.rv, 0.9) FILTER (WHERE b.bar <= q.bar + 96) AS rv_p90, (max(b.high) FILTER (WHERE b.bar <= q.bar + 96) - min(b.low) FILTER (WHERE b.bar <= q.bar + 96)) / any_value(q.close_enter) AS range_pct,
 skewness(b.logret) FILTER (WHERE b.bar <= q.bar + 96) AS skew, kurtosis(b.logret) FILTER (WHERE b.bar <= q.bar + 96) AS kurtosis FROM q JOIN b ON b.symbol = q.symbol AND b.bar BETWEEN q.bar AND greatest(q.leave, q.bar + 96) GROUP BY q.symbol, q.bar, q.ts, q.leave, q.rv_peak, q.peak_at, q.base)
 SELECT symbol, bar AS enter_bar, leave AS exit_bar, ts AS enter_ts, leave - bar + 1 AS duration, leave - bar AS time_to_relax, {s6('rv_peak')} AS rv_peak, peak_at - bar AS t_rv_peak, {s6('base')} AS rv_base, half_life, {s6('auc_excess')} AS auc_excess, second IS NOT NULL AS secondary, second AS time_to_secondary,
 {s6('rv_mean')} AS rv_mean, {s6('rv_p90')} AS rv_p90, {s6('range_pct')} AS range_pct, leave - bar <= 96 AS relaxed, {s6('skew')} AS skew, {s6('kurtosis')} AS kurtosis FROM w""",
)(lambda spark, d: _rounded(vol_shocks(P.numbered(P.cleaned(spark, d)), _SHOCK), "rv_peak", "rv_base", "auc_excess", "rv_mean", "rv_p90", "range_pct", "skew", "kurtosis"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in names})


# --- liquidity vacuums -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vacuum:
    """Windows in bars; `least` values must be there (all of the window, unless given)."""

    shock_quantile: float = 0.99
    volume_window: int = 480
    range_window: int = 480
    volume_floor: float = 0.5
    range_multiple: float = 1.5
    least_bars: int = 3
    most_bars: int = 96
    cooldown: int = 12
    post: int = 96
    auc: int = 96
    expansion: float = 0.02
    least: int | None = None


def vacuum_core(bars: DataFrame, rule: Vacuum = Vacuum(), volume: str = "volume") -> DataFrame:
    """Bars with abs_return, that of the bar before, range_pct, its median, and whether the bar is thin and wide."""
    thin = (ratio(F.col(volume), F.col("vol_mid")) < rule.volume_floor) & (F.col("range_pct") > rule.range_multiple * F.col("range_mid"))
    return in_chunks(
        bars,
        max(rule.volume_window, rule.range_window) + 2,
        lambda: {
            "abs_return": F.abs(ratio(F.col("close"), before("close")) - 1), "range_pct": ratio(F.col("high") - F.col("low"), F.col("close")),
            "vol_mid": OrderStat("quantile", volume, rule.volume_window, rule.least or rule.volume_window), "range_mid": OrderStat("quantile", "range_pct", rule.range_window, rule.least or rule.range_window),
        },
        lambda: {"was": before("abs_return"), "thin": F.coalesce(thin, F.lit(False))},
    )


def vacuum_spans(core: DataFrame, cuts: DataFrame, rule: Vacuum = Vacuum()) -> DataFrame:
    """(symbol, cut columns, bar, leave, ...) of the vacuums kept for each threshold of `cuts` (symbol, cut, ...).

    A vacuum is an onset of the return at the threshold, with at least `least_bars` thin bars right behind it.
    """
    by = [c for c in cuts.columns if c != "cut"]
    stops = core.where("not thin").select("symbol", F.col("bar").alias("_at"), F.col("bar").alias("stop"))
    jumps = asof_join(core.select("symbol", "bar", "n_bars", "abs_return", "was", F.col("bar").alias("_at")), stops, ["symbol"], on="_at", columns=["stop"], forward=True, strict=True, right_time="_found").drop("_at", "_found")
    run = F.least(F.coalesce("stop", F.col("n_bars") + 1) - F.col("bar") - 1, F.lit(rule.most_bars))
    long_ = jumps.withColumn("run", run).where(F.col("run") >= rule.least_bars).join(cuts, "symbol").where((F.col("abs_return") >= F.col("cut")) & (F.col("was") < F.col("cut")))
    return cool_down(long_.select(*by, "cut", "bar", "n_bars", F.col("abs_return").alias("shock_return"), (F.col("bar") + F.col("run")).alias("leave")), by, "bar", "leave", rule.cooldown)


def thresholds(core: DataFrame, quantiles: list[float]) -> DataFrame:
    """(symbol, quantile, cut): several quantiles of the absolute return in one aggregate."""
    at = F.array(*map(F.lit, quantiles))
    each = core.groupBy("symbol").agg(F.percentile("abs_return", at).alias("cuts"))
    return each.select("symbol", F.explode(F.arrays_zip(at.alias("quantile"), F.col("cuts").alias("cut"))).alias("z")).select("symbol", "z.quantile", r9(F.col("z.cut")).alias("cut"))


def vacuums(bars: DataFrame, rule: Vacuum = Vacuum(), volume: str = "volume") -> DataFrame:
    """Liquidity vacuums at the symbol's quantile with their metrics; the first bar is the one behind the jump."""
    core = durable(vacuum_core(bars, rule, volume).select("symbol", "bar", "n_bars", r9(F.col("abs_return")).alias("abs_return"), r9(F.col("was")).alias("was"), "range_pct", "range_mid", "thin"))
    kept = vacuum_spans(core, thresholds(core, [rule.shock_quantile]).drop("quantile"), rule).withColumns({"enter": F.col("bar") + 1, "until": F.col("leave") + max(rule.post, rule.auc)})
    path = core.select("symbol", F.col("bar").alias("at"), "abs_return", "range_pct", "range_mid")
    start, at = F.col("enter"), F.col("at")
    inside = rows_within(path, kept, ["symbol"], "at", "enter", "leave").groupBy("symbol", "bar").agg(
        F.max("range_pct").alias("max_range"), F.min_by("at", F.struct(-F.col("range_pct"), F.col("at"))).alias("peak_at"), F.coalesce(F.max(F.when(at == start, F.col("range_mid"))), F.lit(0.0)).alias("base")
    )
    known = kept.join(inside, ["symbol", "bar"]).withColumn("half", F.col("base") + 0.5 * (F.col("max_range") - F.col("base")))
    later = at > F.col("leave")
    keys = ["symbol", "enter", "leave", "shock_return", "max_range", "peak_at"]
    told = rows_within(path, known, ["symbol"], "at", "enter", "until").groupBy(*keys).agg(
        (F.min(F.when(~later & (F.col("range_pct") <= F.col("half")), at)) - F.first("enter")).alias("half_life"),
        F.max(F.coalesce(later & (at <= F.col("leave") + rule.post) & (F.col("abs_return") >= F.col("cut")), F.lit(False))).alias("secondary_shock"),
        F.max(F.coalesce(later & (at <= F.col("leave") + rule.post) & (F.col("range_pct") >= rule.expansion), F.lit(False))).alias("range_expansion"),
        F.sum(F.when((at <= F.col("leave") + rule.auc) & (F.col("range_pct") > F.col("base")), F.col("range_pct") - F.col("base")).otherwise(0.0)).alias("auc_excess"),
    )
    return told.select("symbol", F.col("enter").alias("enter_bar"), F.col("leave").alias("exit_bar"), (F.col("leave") - start + 1).alias("duration"), "shock_return", "max_range", (F.col("peak_at") - start).alias("t_range_peak"), "half_life", "secondary_shock", "range_expansion", "auc_excess")


def calibrate(bars: DataFrame, quantiles: list[float], least_events: int = 10, rule: Vacuum = Vacuum(), volume: str = "volume") -> DataFrame:
    """(symbol, quantile, threshold, n, enough, chosen): the first quantile with `least_events` vacuums, else the last.

    All thresholds are worked out in one job; a symbol without returns has no row.
    """
    core = durable(vacuum_core(bars, rule, volume).select("symbol", "bar", "n_bars", r9(F.col("abs_return")).alias("abs_return"), r9(F.col("was")).alias("was"), "range_pct", "range_mid", "thin"))
    cuts = thresholds(core, quantiles).where("cut is not null")
    counts = vacuum_spans(core, cuts, rule).groupBy("symbol", "quantile").agg(F.count("*").alias("n"))
    all_ = cuts.join(counts, ["symbol", "quantile"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    choice = all_.groupBy("symbol").agg(F.coalesce(F.min(F.when(F.col("n") >= least_events, F.col("quantile"))), F.max("quantile")).alias("_q"))
    return all_.join(choice, "symbol").select("symbol", "quantile", F.col("cut").alias("threshold"), "n", (F.col("n") >= least_events).alias("enough"), (F.col("quantile") == F.col("_q")).alias("chosen"))


#: On hourly bars of the events table volume and range rise together, so thin and wide are taken less strictly.
_VACUUM, _SWEEP = Vacuum(shock_quantile=0.8, volume_floor=1.1, range_multiple=0.6, least_bars=2, cooldown=4, least=48), [0.5, 0.7, 0.8, 0.9, 0.95]
_VACUUM_SQL = f"""{P.CLEANED_SQL}, l AS (SELECT *, round(abs(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1), 9) AS abs_return, (high - low) / nullif(close, 0) AS range_pct, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar, count(*) OVER (PARTITION BY symbol) AS n_bars FROM cleaned),
 m AS (SELECT *, CASE WHEN count(quote_volume) {P.over(480)} >= 48 THEN median(quote_volume) {P.over(480)} END AS vol_mid, CASE WHEN count(range_pct) {P.over(480)} >= 48 THEN median(range_pct) {P.over(480)} END AS range_mid FROM l),
 b AS (SELECT *, lag(abs_return) OVER (PARTITION BY symbol ORDER BY ts) AS was, coalesce(quote_volume / nullif(vol_mid, 0) < 1.1 AND range_pct > 0.6 * range_mid, FALSE) AS thin FROM m)"""
_RUN = "least(coalesce((SELECT min(x.bar) FROM b x WHERE x.symbol = b.symbol AND x.bar > b.bar AND NOT x.thin), n_bars + 1) - b.bar - 1, 96)"
register(
    "liquidity_vacuum_metrics",
    f"""WITH RECURSIVE {_VACUUM_SQL}, t AS (SELECT symbol, round(quantile_cont(abs_return, 0.8), 9) AS cut FROM b GROUP BY 1), r AS (SELECT b.*, cut, {_RUN} AS run FROM b JOIN t USING (symbol) WHERE abs_return >= cut AND was < cut), spans AS (SELECT symbol, bar, bar + run AS leave, abs_return, cut FROM r WHERE run >= 2), {cooled_sql(4)},
 e AS (SELECT s.symbol, s.bar + 1 AS enter, s.leave, s.abs_return AS shock_return, s.cut, (SELECT range_mid FROM b WHERE b.symbol = s.symbol AND b.bar = s.bar + 1) AS base, (SELECT max(range_pct) FROM b WHERE b.symbol = s.symbol AND b.bar BETWEEN s.bar + 1 AND s.leave) AS max_range FROM kept JOIN spans s USING (symbol, bar))
 SELECT e.symbol, enter AS enter_bar, leave AS exit_bar, leave - enter + 1 AS duration, {s6('any_value(shock_return)')} AS shock_return, {s6('any_value(max_range)')} AS max_range, min(b.bar) FILTER (WHERE b.bar <= leave AND range_pct = max_range) - enter AS t_range_peak, min(b.bar) FILTER (WHERE b.bar <= leave AND range_pct <= base + 0.5 * (max_range - base)) - enter AS half_life,
 coalesce(bool_or(b.bar > leave AND b.abs_return >= cut), FALSE) AS secondary_shock, coalesce(bool_or(b.bar > leave AND range_pct >= 0.02), FALSE) AS range_expansion, {s6('coalesce(sum(range_pct - base) FILTER (WHERE range_pct > base), 0)')} AS auc_excess FROM e JOIN b ON b.symbol = e.symbol AND b.bar BETWEEN enter AND leave + 96 GROUP BY e.symbol, enter, leave""",
)(lambda spark, d: _rounded(vacuums(P.numbered(P.cleaned(spark, d)), _VACUUM, "quote_volume"), "shock_return", "max_range", "auc_excess"))
register(
    "vacuum_calibration",
    f"""WITH RECURSIVE {_VACUUM_SQL}, t AS (SELECT symbol, unnest({_SWEEP}) AS quantile, round(unnest(quantile_cont(abs_return, {_SWEEP})), 9) AS cut FROM b GROUP BY 1), r AS (SELECT b.symbol, b.bar, {_RUN} AS run, b.abs_return, b.was FROM b), spans AS (SELECT symbol, quantile, bar, bar + run AS leave FROM r JOIN t USING (symbol) WHERE run >= 2 AND abs_return >= cut AND was < cut), {cooled_sql(4, 'symbol, quantile')},
 n AS (SELECT t.*, (SELECT count(*) FROM kept k WHERE k.symbol = t.symbol AND k.quantile = t.quantile) AS n FROM t WHERE cut IS NOT NULL), f AS (SELECT symbol, coalesce(min(quantile) FILTER (WHERE n >= 25), max(quantile)) AS q FROM n GROUP BY 1)
 SELECT symbol, quantile, {s6('cut')} AS threshold, n, n >= 25 AS enough, quantile = q AS chosen FROM n JOIN f USING (symbol)""",
)(lambda spark, d: _rounded(calibrate(P.numbered(P.cleaned(spark, d)), _SWEEP, 25, _VACUUM, "quote_volume"), "threshold"))


# --- controls by the nearest volatility ------------------------------------------------------------------

#: Bars near an event by realised volatility: so many are looked at, and so many of these are drawn.
NEAREST, DRAWS = 200, 3
_SIDES = f"WITH {P.features_sql()}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar FROM feat), q AS (SELECT symbol, round(quantile_cont(abs_basis_z, 0.9), 9) AS cut FROM feat GROUP BY 1), e AS (SELECT symbol, bar, round(rv, 9) AS rv FROM b JOIN q USING (symbol) WHERE round(abs_basis_z, 9) >= cut AND rv IS NOT NULL), pool AS (SELECT symbol, bar AS control, round(rv, 9) AS rv, row_number() OVER (PARTITION BY symbol ORDER BY round(rv, 9), bar) AS pos FROM b JOIN q USING (symbol) WHERE round(abs_basis_z, 9) < cut AND rv IS NOT NULL)"


@register(
    "control_nearest_ids",
    f"""{_SIDES}, p AS (SELECT e.*, (SELECT count(*) FROM pool WHERE pool.symbol = e.symbol AND pool.rv <= e.rv) AS place FROM e),
 n AS (SELECT p.symbol, p.bar, control, abs(p.rv - pool.rv) AS distance, row_number() OVER (PARTITION BY p.symbol, p.bar ORDER BY abs(p.rv - pool.rv), pos > place, abs(pos - place)) AS near FROM p JOIN pool USING (symbol)),
 d AS (SELECT *, row_number() OVER (PARTITION BY symbol, bar ORDER BY md5(concat_ws('|', symbol, bar, control))) AS draw FROM n WHERE near <= {NEAREST})
 SELECT symbol, bar, draw, control, near, {s6('distance')} AS distance FROM d WHERE draw <= {DRAWS}""",
)
def control_nearest_ids(spark: SparkSession, d: str) -> DataFrame:
    """For bars whose venues lie far apart: which calm bars of like volatility they are held against, drawn from the nearest."""
    bars = durable(P.numbered(P.features(P.cleaned(spark, d))).select("symbol", "bar", "rv", "abs_basis_z"))
    cuts = bars.groupBy("symbol").agg(r9(F.percentile("abs_basis_z", F.lit(0.9))).alias("cut"))
    own = bars.join(cuts, "symbol").where("rv is not null").select("symbol", "bar", r9(F.col("rv")).alias("rv"), (r9(F.col("abs_basis_z")) >= F.col("cut")).alias("far"))
    near = nearest(own.where("far"), own.where("not far").select("symbol", F.col("bar").alias("control"), "rv"), ["symbol"], "rv", "bar", "control", NEAREST, block=0.5)
    return drawn(near, ["symbol"], "bar", DRAWS, F.md5(F.concat_ws("|", "symbol", "bar", "control").cast("binary"))).select("symbol", "bar", "draw", "control", "near", r6(F.col("distance")).alias("distance"))
