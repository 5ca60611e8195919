"""Registered queries over the tables, each with its DuckDB statement where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import ordered
from ..functions.order_windows import OrderStat, add_order_statistics
from ..functions.tails import normal_two_sided
from ..operators.align import active_on_grid, asof_join, keep_one, repeated_keys, own_rows, runs
from ..operators.greedy import cool_down, space_out
from ..operators.pooling import newey_west, pool, profit_parts, static_cost
from ..operators.testing import bh_adjust, simes
from ..sources.readers import parse_klines
from ..streaming.streams import event_stream, stream_bars, stream_dedupe
from . import panel as P
from .detectors import HELPERS, RULES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
W = ordered


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r6(c):
    return F.round(c, 6)


def s6(text: str) -> str:
    return f"round({text}, 6) + 0.0"


# --- features: one query each -------------------------------------------------------------------------

#: Columns of rules only, that are no features of their own.
_INNER = {"ret_mean_3", "prev_high", "prev_low", "vol_base", "range_base", "broke", "broke_before", "top_24", "bottom_24", "top_48", "bottom_48", "mean_24", "sd_24"}
for _level in P.LEVELS:
    for _name in [n for n in _level if n not in _INNER]:
        register(f"feature_{_name}", f"WITH {P.features_sql()} SELECT symbol, ts, {s6(_name)} AS value FROM feat")(
            lambda spark, d, n=_name: P.features(P.cleaned(spark, d)).select("symbol", "ts", r6(F.col(n)).alias("value"))
        )


# --- sources, grids, gaps ------------------------------------------------------------------------------

register("ohlc_from_ticks", f"WITH {P.BARS_SQL} SELECT symbol, ts, open, high, low, close, volume, {s6('quote_volume')} AS quote_volume FROM bars")(
    lambda spark, d: P.bars(spark, d).select("symbol", "ts", "open", "high", "low", "close", "volume", r6(F.col("quote_volume")).alias("quote_volume"))
)
register("grid_reindex", f"WITH {P.CLEANED_SQL} SELECT symbol, ts, close, volume, is_gap FROM cleaned")(lambda spark, d: P.cleaned(spark, d).select("symbol", "ts", "close", "volume", "is_gap"))
register(
    "gap_length",
    f"""WITH {P.CLEANED_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, is_gap ORDER BY ts) AS g FROM cleaned)
SELECT symbol, ts, CAST(CASE WHEN is_gap THEN count(*) OVER (PARTITION BY symbol, is_gap, g) ELSE 0 END AS BIGINT) AS gap_len FROM c""",
)(lambda spark, d: runs(P.cleaned(spark, d), F.col("is_gap"), ["symbol"]).select("symbol", "ts", F.when(F.col("is_gap"), F.col("run_length")).otherwise(0).alias("gap_len")))
register(
    "missing_ranges",
    f"""WITH {P.CLEANED_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, is_gap ORDER BY ts) AS g FROM cleaned)
SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_missing FROM c WHERE is_gap GROUP BY symbol, g""",
)(
    lambda spark, d: runs(P.cleaned(spark, d), F.col("is_gap"), ["symbol"]).where("is_gap").groupBy("symbol", "run_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_missing")).drop("run_id")
)
register(
    "expected_vs_actual",
    f"WITH {P.CLEANED_SQL} SELECT symbol, count(*) AS expected, count(close) AS actual FROM cleaned GROUP BY symbol",
)(lambda spark, d: P.cleaned(spark, d).groupBy("symbol").agg(F.count("*").alias("expected"), F.count("close").alias("actual")))
register(
    "dedupe_keep",
    "SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
)(lambda spark, d: keep_one(P.table(spark, d, "events"), ["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_type", "ts", "event_id", "value"))
register(
    "ffill_limited",
    f"WITH {P.CLEANED_SQL} SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS filled FROM cleaned",
)(lambda spark, d: P.cleaned(spark, d).select("symbol", "ts", F.last("close", ignorenulls=True).over(W().rowsBetween(-3, 0)).alias("filled")))
register(
    "ffill_bfill",
    f"""WITH {P.CLEANED_SQL} SELECT symbol, ts, coalesce(last_value(venue_a IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(venue_a IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM (SELECT symbol, ts, {s6('venue_a')} AS venue_a FROM cleaned)""",
)(
    lambda spark, d: P.cleaned(spark, d).withColumn("v", r6(F.col("venue_a"))).select(
        "symbol", "ts", F.coalesce(F.last("v", ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0)), F.first("v", ignorenulls=True).over(W().rowsBetween(0, Window.unboundedFollowing))).alias("filled")
    )
)
register(
    "resample_8h",
    """SELECT event_type AS symbol, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '2024-01-01') AS start_ts, count(*) AS n, round(avg(value), 6) + 0.0 AS mean_value, max(value) AS max_value,
 round(stddev_samp(value), 6) + 0.0 AS sd_value, last(value ORDER BY ts, event_id) AS last_value FROM events GROUP BY 1, 2""",
)(
    lambda spark, d: P.table(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), F.window("ts", "8 hours").alias("w")).agg(
        F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"), F.max("value").alias("max_value"), r6(F.stddev_samp("value")).alias("sd_value"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value")
    ).select("symbol", F.col("w.start").cast("timestamp_ntz").alias("start_ts"), "n", "mean_value", "max_value", "sd_value", "last_value")
)
register("filter_window", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")(
    lambda spark, d: P.table(spark, d, "events").where("ts >= timestamp_ntz'2024-01-05' AND ts < timestamp_ntz'2024-01-08'").select("event_id", "ts")
)
register(
    "norm_funding_scale",
    f"""WITH {P.features_sql()}, m AS (SELECT symbol, max(abs(funding)) * 1e4 AS top FROM feat GROUP BY symbol), s AS (SELECT symbol, top, CASE WHEN top <= 0.05 THEN 1.0 WHEN top * 0.01 <= 0.05 THEN 0.01 ELSE 1e-4 END AS scale FROM m)
SELECT symbol, scale, {s6('0.5 + 0.49 * least(1.0, top * scale / 0.05)')} AS confidence FROM s""",
)(
    lambda spark, d: P.features(P.cleaned(spark, d)).groupBy("symbol").agg((F.max(F.abs("funding")) * 1e4).alias("top")).withColumn("scale", F.when(F.col("top") <= 0.05, 1.0).when(F.col("top") * 0.01 <= 0.05, 0.01).otherwise(1e-4)).select(
        "symbol", "scale", r6(0.5 + 0.49 * F.least(F.lit(1.0), F.col("top") * F.col("scale") / 0.05)).alias("confidence")
    )
)
register("round_ts_hour", "SELECT event_id, date_trunc('hour', ts + INTERVAL 30 MINUTE) AS rounded FROM events")(
    lambda spark, d: P.table(spark, d, "events").select("event_id", F.date_trunc("HOUR", F.col("ts") + F.expr("interval 30 minutes")).cast("timestamp_ntz").alias("rounded"))
)


# --- joins ------------------------------------------------------------------------------------------

_ERR = "err AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'error')"
_BUY = "buy AS (SELECT user_id, ts, max(event_id) AS buy_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)"


def _errors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = P.table(spark, d, "events")
    return e.where("event_type = 'error'").select("user_id", "ts", "event_id", "value"), e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("buy_id"))


def _asof(name: str, sql: str, **kw) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        left, right = _errors(spark, d)
        extra = {"tolerance": F.expr(kw["tolerance"])} if "tolerance" in kw else {}
        joined = asof_join(left, right, ["user_id"], forward=kw.get("forward", False), strict=kw.get("strict", False), **extra)
        return joined.select("event_id", "buy_id", "matched_ts")

    register(name, sql)(f)


_JOINED = "SELECT e.event_id, b.buy_id, b.ts AS matched_ts FROM err e ASOF LEFT JOIN buy b ON e.user_id = b.user_id AND"
_asof("asof_backward", f"WITH {_ERR}, {_BUY} {_JOINED} e.ts >= b.ts")
_asof("asof_backward_tolerance", f"WITH {_ERR}, {_BUY}, j AS ({_JOINED} e.ts >= b.ts) SELECT j.event_id, CASE WHEN j.matched_ts >= e.ts - INTERVAL 4 HOUR THEN buy_id END AS buy_id, CASE WHEN j.matched_ts >= e.ts - INTERVAL 4 HOUR THEN matched_ts END AS matched_ts FROM j JOIN err e USING (event_id)", tolerance="interval 4 hours")
_asof("asof_forward_snap", f"WITH {_ERR}, {_BUY} {_JOINED} e.ts <= b.ts", forward=True)
_asof("asof_forward_strict", f"WITH {_ERR}, {_BUY} {_JOINED} e.ts < b.ts", forward=True, strict=True)
register("asof_cardinality_guard", "SELECT user_id, ts, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")(lambda spark, d: repeated_keys(P.table(spark, d, "events"), ["user_id", "ts"]))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    b = P.cleaned(spark, d).where("close > 400").select("symbol", F.col("ts").alias("enter_ts"), (F.col("ts") + F.expr("interval 3 hours")).alias("exit_ts"))
    return b


register(
    "interval_active",
    f"""WITH {P.CLEANED_SQL}, s AS (SELECT symbol, ts AS a, ts + INTERVAL 3 HOUR AS b FROM cleaned WHERE close > 400)
SELECT c.symbol, c.ts, EXISTS (SELECT 1 FROM s WHERE s.symbol = c.symbol AND c.ts BETWEEN s.a AND s.b) AS active FROM cleaned c""",
)(lambda spark, d: active_on_grid(P.cleaned(spark, d).select("symbol", "ts"), _spans(spark, d), ["symbol"]))
register(
    "inner_equi",
    f"WITH {P.BARS_SQL} SELECT a.ts, {s6('a.close / nullif(b.close, 0) - 1')} AS basis FROM bars a JOIN bars b ON a.ts = b.ts WHERE a.symbol = 'click' AND b.symbol = 'view'",
)(
    lambda spark, d: P.bars(spark, d).where("symbol = 'click'").select("ts", F.col("close").alias("a")).join(P.bars(spark, d).where("symbol = 'view'").select("ts", F.col("close").alias("b")), "ts").select("ts", r6(F.col("a") / F.nullif(F.col("b"), F.lit(0.0)) - 1).alias("basis"))
)
register(
    "outer_equi_coalesce",
    f"WITH {P.BARS_SQL}, a AS (SELECT ts, close FROM bars WHERE symbol = 'error'), b AS (SELECT ts, close FROM bars WHERE symbol = 'signup') SELECT coalesce(a.ts, b.ts) AS ts, coalesce(a.close, b.close) AS close FROM a FULL JOIN b ON a.ts = b.ts",
)(
    lambda spark, d: P.bars(spark, d).where("symbol = 'error'").select("ts", F.col("close").alias("a")).join(P.bars(spark, d).where("symbol = 'signup'").select("ts", F.col("close").alias("b")), "ts", "full").select("ts", F.coalesce("a", "b").alias("close"))
)
register("left_equi", "SELECT o.o_orderkey, c.c_acctbal FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")(
    lambda spark, d: P.table(spark, d, "orders").join(P.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_acctbal")
)
register("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")(
    lambda spark, d: P.table(spark, d, "customer").join(P.table(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")
)
register("anti_join", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")(
    lambda spark, d: P.table(spark, d, "customer").join(P.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
)


def counted_broadcast(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The table, marked for broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


register("broadcast_all", "SELECT e.event_id, s.symbol FROM events e CROSS JOIN (SELECT DISTINCT event_type AS symbol FROM events) s WHERE e.event_type = 'signup'")(
    lambda spark, d: P.table(spark, d, "events").where("event_type = 'signup'").select("event_id").crossJoin(counted_broadcast(P.table(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct()))
)


# --- detection ---------------------------------------------------------------------------------------


def panel(spark: SparkSession, d: str, chunk: int = P.CHUNK) -> DataFrame:
    """The chunked panel with all that rules look at, the bar's number, and the forward return over three bars from the next one on."""
    df = P.thresholds(P.add_features(P.chunked(P.numbered(P.cleaned(spark, d)).drop("n_bars"), chunk)))
    fwd = F.lead("close", 4).over(P.W()) / F.nullif(F.lead("close", 1).over(P.W()), F.lit(0.0)) - 1
    helped = df.withColumns({n: F.expr(t.replace("PARTITION BY symbol", "PARTITION BY symbol, _chunk")) for n, t in HELPERS.items()} | {"fwd": fwd})
    return own_rows(helped)


def hits(spark: SparkSession, d: str, chunk: int = P.CHUNK) -> DataFrame:
    """(event_type, symbol, ts, bar, fwd) of every bar that fulfils a rule, all rules in one pass over the panel."""
    found = F.array_compact(F.array(*[F.when(F.expr(rule), F.struct(F.lit(n).alias("event_type"), F.lit(gap).alias("gap"))) for n, (rule, gap) in RULES.items()]))
    return panel(spark, d, chunk).select("symbol", "ts", "bar", "fwd", F.explode(found).alias("e")).select("e.event_type", "e.gap", "symbol", "ts", "bar", "fwd")


_HITS_SQL = (
    f"{P.features_sql()}, {P.thresholds_sql()}, helped AS (SELECT *, {', '.join(f'{t} AS {n}' for n, t in HELPERS.items())}, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar FROM thr), hits AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS event_type, {gap} AS gap, symbol, ts, bar FROM helped WHERE {rule}" for n, (rule, gap) in RULES.items())
    + ")"
)
_KEPT_SQL = """kept AS (SELECT event_type, symbol, gap, min(bar) AS bar FROM hits GROUP BY 1, 2, 3
 UNION ALL SELECT k.event_type, k.symbol, k.gap, min(h.bar) FROM kept k JOIN hits h ON h.event_type = k.event_type AND h.symbol = k.symbol AND h.bar >= k.bar + k.gap GROUP BY k.event_type, k.symbol, k.gap, k.bar)"""


def detect(spark: SparkSession, d: str) -> DataFrame:
    return space_out(hits(spark, d), ["event_type", "symbol"], "bar", "gap").select("event_type", "symbol", "ts", "bar", "fwd")


register("detect_hits", f"WITH {_HITS_SQL} SELECT event_type, symbol, count(*) AS n FROM hits GROUP BY 1, 2")(lambda spark, d: hits(spark, d).groupBy("event_type", "symbol").agg(F.count("*").alias("n")))
register("detect_all", f"WITH RECURSIVE {_HITS_SQL}, {_KEPT_SQL} SELECT h.event_type, h.symbol, h.ts, h.bar FROM hits h JOIN kept k USING (event_type, symbol, bar)")(lambda spark, d: detect(spark, d).drop("fwd"))

_SPANS_SQL = f"""{P.CLEANED_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar FROM cleaned), spans AS (SELECT symbol, bar, bar + 1 + CAST(volume AS BIGINT) % 4 AS leave FROM b WHERE close > 250)"""
register(
    "cooldown_greedy",
    f"""WITH RECURSIVE {_SPANS_SQL}, kept AS (SELECT symbol, bar, leave FROM spans s WHERE bar = (SELECT min(bar) FROM spans t WHERE t.symbol = s.symbol)
 UNION ALL SELECT n.symbol, n.bar, s.leave FROM (SELECT k.symbol, min(s.bar) AS bar FROM kept k JOIN spans s ON s.symbol = k.symbol AND s.bar > k.leave + 4 GROUP BY k.symbol, k.bar) n JOIN spans s ON s.symbol = n.symbol AND s.bar = n.bar)
SELECT symbol, bar, leave FROM kept""",
)(
    lambda spark, d: cool_down(
        P.cleaned(spark, d).withColumn("bar", F.row_number().over(W()).cast("long")).where("close > 250").select("symbol", "bar", (F.col("bar") + 1 + F.col("volume").cast("long") % 4).alias("leave")), ["symbol"], "bar", "leave", 4
    )
)
register(
    "run_islands",
    f"""WITH {P.CLEANED_SQL}, f AS (SELECT symbol, ts, coalesce(close > 200, FALSE) AS flag FROM cleaned), g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, flag ORDER BY ts) AS g FROM f)
SELECT symbol, min(ts) AS first_ts, count(*) AS n FROM g WHERE flag GROUP BY symbol, g""",
)(
    lambda spark, d: runs(P.cleaned(spark, d), F.col("close") > 200, ["symbol"]).where("close > 200").groupBy("symbol", "run_id").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).drop("run_id")
)
register(
    "onset",
    f"WITH {P.CLEANED_SQL} SELECT symbol, ts FROM (SELECT symbol, ts, coalesce(close > 200, FALSE) AS c, coalesce(lag(close > 200) OVER (PARTITION BY symbol ORDER BY ts), FALSE) AS p FROM cleaned) WHERE c AND NOT p",
)(lambda spark, d: P.cleaned(spark, d).withColumns({"c": F.coalesce(F.col("close") > 200, F.lit(False)), "p": F.coalesce(F.lag(F.col("close") > 200).over(W()), F.lit(False))}).where("c AND NOT p").select("symbol", "ts"))
register(
    "first_hit",
    f"""WITH {P.CLEANED_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar FROM cleaned)
SELECT symbol, ts, min(CASE WHEN close > 300 THEN bar END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) - bar AS bars_to_hit FROM b""",
)(
    lambda spark, d: P.cleaned(spark, d).withColumn("bar", F.row_number().over(W()).cast("long")).select("symbol", "ts", (F.min(F.when(F.col("close") > 300, F.col("bar"))).over(W().rowsBetween(1, 24)) - F.col("bar")).alias("bars_to_hit"))
)


# --- labels and statistics -----------------------------------------------------------------------------


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Detected events with their lagged forward return over three bars."""
    return detect(spark, d)


_LABELLED_SQL = f"{_HITS_SQL}, {_KEPT_SQL}, fw AS (SELECT symbol, ts, lead(close, 4) OVER (PARTITION BY symbol ORDER BY ts) / nullif(lead(close, 1) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS fwd FROM cleaned), lab AS (SELECT h.event_type, h.symbol, h.ts, h.bar, fw.fwd FROM hits h JOIN kept k USING (event_type, symbol, bar) JOIN fw ON fw.symbol = h.symbol AND fw.ts = h.ts)"


def study(spark: SparkSession, d: str) -> DataFrame:
    g = labelled(spark, d).where("fwd is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean"), F.stddev_pop("fwd").alias("sd"))
    return g.withColumn("t_stat", F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0)))


_STUDY_SQL = f"{_LABELLED_SQL}, st AS (SELECT event_type, count(*) AS n, avg(fwd) AS mean, stddev_pop(fwd) AS sd FROM lab WHERE fwd IS NOT NULL GROUP BY 1), study AS (SELECT *, mean / nullif(sd / sqrt(n), 0) AS t_stat FROM st)"
register("fwd_return_lagged", f"WITH RECURSIVE {_LABELLED_SQL} SELECT event_type, symbol, ts, {s6('fwd')} AS fwd FROM lab")(lambda spark, d: labelled(spark, d).select("event_type", "symbol", "ts", r6(F.col("fwd")).alias("fwd")))
register("expectancy_kernel", f"WITH RECURSIVE {_STUDY_SQL} SELECT event_type, n, {s6('mean')} AS mean, {s6('sd')} AS sd, {s6('t_stat')} AS t_stat FROM study")(
    lambda spark, d: study(spark, d).select("event_type", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "sd", "t_stat")])
)


@register("expectancy_p_values")
def expectancy_p_values(spark: SparkSession, d: str) -> DataFrame:
    tested = study(spark, d).where("n >= 5 and t_stat is not null").withColumn("p_value", normal_two_sided(F.col("t_stat"))).withColumn("family", F.split("event_type", "_")[0])
    adjusted = bh_adjust(tested, "p_value", "q_value", [])
    return adjusted.join(simes(tested, "p_value", ["family"]), "family").select("event_type", "family", "n", "p_value", "q_value", "simes_p")


_P = "p AS (SELECT l_partkey % 500 AS id, l_suppkey % 10 AS family, round(count(*) / (1.0 + sum(l_quantity)), 6) AS p FROM lineitem GROUP BY 1, 2)"


def _p(spark: SparkSession, d: str) -> DataFrame:
    return P.table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 500).alias("id"), (F.col("l_suppkey") % 10).alias("family")).agg(F.round(F.count("*") / (1.0 + F.sum("l_quantity")), 6).alias("p"))


register(
    "bh_adjust",
    f"WITH {_P}, r AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY p) + count(*) OVER (PARTITION BY family, p) - 1 AS k, count(*) OVER (PARTITION BY family) AS m FROM p) SELECT family, id, p, {s6('least(1.0, min(p * m / k) OVER (PARTITION BY family ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS q FROM r",
)(lambda spark, d: bh_adjust(_p(spark, d), "p", "q", ["family"]).select("family", "id", "p", r6(F.col("q")).alias("q")))
register("simes_p", f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k, count(*) OVER (PARTITION BY family) AS m FROM p) SELECT family, {s6('least(1.0, min(p * m / k))')} AS simes_p FROM r GROUP BY family")(
    lambda spark, d: simes(_p(spark, d), "p", ["family"]).select("family", r6(F.col("simes_p")).alias("simes_p"))
)
register(
    "dist_stats",
    f"WITH {P.features_sql()} SELECT symbol, count(ret_1) AS n, {s6('avg(ret_1)')} AS mean, {s6('quantile_cont(ret_1, 0.5)')} AS median, {s6('stddev_samp(ret_1)')} AS sd, {s6('quantile_cont(ret_1, 0.05)')} AS p05, {s6('quantile_cont(ret_1, 0.95)')} AS p95, {s6('avg(CASE WHEN ret_1 > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate FROM feat WHERE ret_1 IS NOT NULL GROUP BY symbol",
)(
    lambda spark, d: P.features(P.cleaned(spark, d)).where("ret_1 is not null").groupBy("symbol").agg(
        F.count("ret_1").alias("n"), r6(F.avg("ret_1")).alias("mean"), r6(F.percentile("ret_1", F.lit(0.5))).alias("median"), r6(F.stddev_samp("ret_1")).alias("sd"), r6(F.percentile("ret_1", F.lit(0.05))).alias("p05"), r6(F.percentile("ret_1", F.lit(0.95))).alias("p95"), r6(F.avg(F.when(F.col("ret_1") > 0, 1.0).otherwise(0.0))).alias("win_rate")
    )
)
register(
    "summary_grouping_sets",
    f"WITH {P.features_sql()} SELECT symbol, hour(ts) // 8 AS session, count(*) AS n, {s6('quantile_cont(bar_range, 0.5)')} AS median, {s6('quantile_cont(bar_range, 0.75)')} AS p75 FROM feat WHERE bar_range IS NOT NULL GROUP BY GROUPING SETS ((), (symbol), (hour(ts) // 8), (symbol, hour(ts) // 8))",
)(
    lambda spark, d: P.features(P.cleaned(spark, d)).where("bar_range is not null").select("symbol", F.floor(F.hour("ts") / 8).alias("session"), "bar_range").cube("symbol", "session").agg(F.count("*").alias("n"), r6(F.percentile("bar_range", F.lit(0.5))).alias("median"), r6(F.percentile("bar_range", F.lit(0.75))).alias("p75"))
)
_LAGS = range(1, 11)
_RHOS = " + ".join(f"CASE WHEN count(*) // 10 >= {k} AND isfinite(corr(x, x{k})) THEN corr(x, x{k}) ELSE 0 END" for k in _LAGS)
register(
    "ess_autocorr",
    f"""WITH {P.features_sql()}, l AS (SELECT symbol, ret_1 AS x, {', '.join(f'lag(ret_1, {k}) OVER (PARTITION BY symbol ORDER BY ts) AS x{k}' for k in _LAGS)} FROM feat WHERE ret_1 IS NOT NULL)
SELECT symbol, count(*) AS n, {s6(f'greatest(0.0, least(count(*), count(*) / greatest(1e-6, 1 + 2 * ({_RHOS}))))')} AS ess FROM l GROUP BY symbol""",
)(lambda spark, d: effective_size(P.features(P.cleaned(spark, d)).where("ret_1 is not null"), "ret_1"))


def effective_size(series: DataFrame, value: str, most: int = _LAGS[-1]) -> DataFrame:
    """n / (1 + 2 sum of autocorrelations) over at most `most` and a tenth of n lags, within 0 and n."""
    x, n = F.col(value), F.count("*")
    lags = series.select("symbol", x.alias("x"), *[F.lag(x, k).over(W()).alias(f"x{k}") for k in range(1, most + 1)])
    rho = lambda k: F.when(n >= 10 * k, F.coalesce(F.nanvl(F.corr("x", f"x{k}"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    size = n / F.greatest(F.lit(1e-6), 1 + 2 * sum((rho(k) for k in range(1, most + 1)), F.lit(0.0)))
    return lags.groupBy("symbol").agg(n.alias("n"), r6(F.greatest(F.lit(0.0), F.least(n.cast("double"), size))).alias("ess"))


register(
    "cum_pnl_drawdown",
    f"WITH {P.features_sql()}, c AS (SELECT symbol, ts, sum(coalesce(score * ret_1, 0)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum FROM feat) SELECT symbol, ts, {s6('cum')} AS cum_pnl, {s6('cum - max(cum) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)')} AS drawdown FROM c",
)(
    lambda spark, d: P.features(P.cleaned(spark, d)).withColumn("cum", F.sum(F.coalesce(F.col("score") * F.col("ret_1"), F.lit(0.0))).over(W().rowsBetween(Window.unboundedPreceding, 0))).select("symbol", "ts", r6(F.col("cum")).alias("cum_pnl"), r6(F.col("cum") - F.max("cum").over(W().rowsBetween(Window.unboundedPreceding, 0))).alias("drawdown"))
)
register(
    "cross_section",
    f"WITH {P.features_sql()} SELECT symbol, ts, {s6('(trend - avg(trend) OVER w) / nullif(stddev_samp(trend) OVER w, 0)')} AS z, {s6('dense_rank() OVER (PARTITION BY ts ORDER BY trend) * 1.0 / count(*) OVER w')} AS cs_rank FROM feat WHERE trend IS NOT NULL WINDOW w AS (PARTITION BY ts) QUALIFY count(*) OVER w >= 3",
)(lambda spark, d: _cross(P.features(P.cleaned(spark, d)).where("trend is not null")))


def _cross(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("ts")
    df = df.withColumns({"n": F.count("*").over(w), "m": F.avg("trend").over(w), "s": F.stddev_samp("trend").over(w), "k": F.dense_rank().over(w.orderBy("trend"))}).where("n >= 3")
    return df.select("symbol", "ts", r6((F.col("trend") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).alias("z"), r6(F.col("k") / F.col("n")).alias("cs_rank"))


register(
    "rolling_pct_rank",
    f"WITH {P.CLEANED_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar FROM cleaned) SELECT a.symbol, a.ts, {s6('CASE WHEN count(b.quote_volume) >= 24 THEN sum(CASE WHEN b.quote_volume <= a.quote_volume THEN 1.0 ELSE 0.0 END) / count(*) END')} AS pct FROM b a JOIN b ON a.symbol = b.symbol AND b.bar BETWEEN a.bar - 23 AND a.bar GROUP BY a.symbol, a.ts",
)(lambda spark, d: own_rows(add_order_statistics(P.chunked(P.cleaned(spark, d).select("symbol", "ts", "quote_volume")), {"pct": OrderStat("pct_rank", "quote_volume", 24, 24)}, P.KEYS)).select("symbol", "ts", r6(F.col("pct")).alias("pct")))
register(
    "state_labels",
    f"WITH {P.features_sql()} SELECT symbol, ts, CASE WHEN rv_z IS NULL THEN 'unknown' WHEN rv_z <= -0.5 THEN 'low' WHEN rv_z <= 0.5 THEN 'mid' ELSE 'high' END AS vol_regime, CASE WHEN funding < -0.00001 THEN 'neg' WHEN funding > 0.00001 THEN 'pos' ELSE 'neutral' END AS carry, CASE WHEN trend > 0 THEN 'bull' WHEN trend < 0 THEN 'bear' ELSE 'flat' END AS trend_state, coalesce(ratio_now <= 0.8, FALSE) AS compression FROM feat",
)(
    lambda spark, d: P.features(P.cleaned(spark, d)).select(
        "symbol", "ts", F.when(F.col("rv_z").isNull(), "unknown").when(F.col("rv_z") <= -0.5, "low").when(F.col("rv_z") <= 0.5, "mid").otherwise("high").alias("vol_regime"), F.when(F.col("funding") < -0.00001, "neg").when(F.col("funding") > 0.00001, "pos").otherwise("neutral").alias("carry"),
        F.when(F.col("trend") > 0, "bull").when(F.col("trend") < 0, "bear").otherwise("flat").alias("trend_state"), F.coalesce(F.col("ratio_now") <= 0.8, F.lit(False)).alias("compression"),
    )
)
register(
    "dq_nulls",
    f"WITH {P.features_sql()} SELECT " + ", ".join(f"{s6(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS {c}" for c in ("close", "rv", "basis_z", "rv_z")) + " FROM feat",
)(lambda spark, d: P.features(P.cleaned(spark, d)).agg(*[r6(F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0))).alias(c) for c in ("close", "rv", "basis_z", "rv_z")]))
register("topk_rank", "SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")(
    lambda spark, d: P.table(spark, d, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")).where("k <= 3").select("o_custkey", "o_orderkey", "k")
)


# --- pooling, costs, profit ---------------------------------------------------------------------------

_CAND = "cand AS (SELECT l_returnflag AS family, l_linestatus AS state, l_suppkey % 20 AS unit, count(*) AS n, avg(l_discount) AS effect, stddev_samp(l_discount) AS sd FROM lineitem GROUP BY 1, 2, 3)"


def _pooled_sql() -> str:
    """Two levels with joins of grouped tables: families of states, states of units."""
    return f"""WITH {_CAND}, st AS (SELECT family, state, sum(n) AS n, sum(n * effect) / sum(n) AS m FROM cand GROUP BY 1, 2),
 sv AS (SELECT c.family, c.state, any_value(st.n) AS n, any_value(st.m) AS m, sum((c.n - 1) * c.sd * c.sd + c.n * (c.effect - st.m) * (c.effect - st.m)) / greatest(any_value(st.n) - 1, 1) AS v, count(*) AS k,
  sum((c.n - 1) * c.sd * c.sd) / greatest(sum(c.n - 1), 1) AS w_in, sum(c.n * (c.effect - st.m) * (c.effect - st.m)) / sum(c.n) AS b_in FROM cand c JOIN st USING (family, state) GROUP BY 1, 2),
 fa AS (SELECT family, sum(n) AS n, sum(n * m) / sum(n) AS m FROM sv GROUP BY 1),
 fv AS (SELECT s.family, any_value(fa.n) AS n, any_value(fa.m) AS m, count(*) AS k, sum((s.n - 1) * s.v) / greatest(sum(s.n - 1), 1) AS w_in, sum(s.n * (s.m - fa.m) * (s.m - fa.m)) / sum(s.n) AS b_in FROM sv s JOIN fa USING (family) GROUP BY 1),
 lam AS (SELECT c.*, s.n AS ns, s.m AS ms, f.m AS mf, CASE WHEN f.n < 200 THEN 0 WHEN f.k = 1 THEN 5000 ELSE greatest(5, least(5000, f.w_in / greatest(f.b_in, 1e-8))) END AS l1, CASE WHEN s.n < 200 THEN 0 WHEN s.k = 1 THEN 5000 ELSE greatest(5, least(5000, s.w_in / greatest(s.b_in, 1e-8))) END AS l2 FROM cand c JOIN sv s USING (family, state) JOIN fv f USING (family))
SELECT family, state, unit, n, {s6('l2')} AS lambda, {s6('n / (n + l2)')} AS weight, {s6('n / (n + l2) * effect + l2 / (n + l2) * (ns / (ns + l1) * ms + l1 / (ns + l1) * mf)')} AS pooled FROM lam"""


@register("hierarchical_shrinkage", _pooled_sql())
def hierarchical_shrinkage(spark: SparkSession, d: str) -> DataFrame:
    line = P.table(spark, d, "lineitem")
    cand = line.groupBy(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("state"), (F.col("l_suppkey") % 20).alias("unit")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("effect"), F.stddev_samp("l_discount").alias("sd"))
    return pool(cand, [["family"], ["family", "state"]]).select("family", "state", "unit", "n", r6(F.col("lambda")).alias("lambda"), r6(F.col("weight")).alias("weight"), r6(F.col("pooled")).alias("pooled"))


@register(
    "pnl_components",
    f"""WITH {P.features_sql()}, p AS (SELECT symbol, ts, is_gap, funding, ret_1, CASE WHEN px_z > 1 THEN -1.0 WHEN px_z < -1 THEN 1.0 ELSE 0.0 END AS pos FROM feat), q AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY ts), 0.0) AS prev FROM p),
c AS (SELECT symbol, ts, CASE WHEN is_gap THEN 0.0 ELSE coalesce(prev * ret_1, 0.0) END AS gross_pnl, CASE WHEN is_gap THEN 0.0 ELSE coalesce(abs(pos - prev) * 6.0 / 10000, 0.0) END AS trading_cost, CASE WHEN is_gap THEN 0.0 ELSE coalesce(-prev * funding, 0.0) END AS funding_pnl FROM q)
SELECT symbol, ts, {s6('gross_pnl')} AS gross_pnl, {s6('trading_cost')} AS trading_cost, {s6('funding_pnl')} AS funding_pnl, {s6('gross_pnl - trading_cost + funding_pnl')} AS pnl FROM c""",
)
def pnl_components(spark: SparkSession, d: str) -> DataFrame:
    df = P.features(P.cleaned(spark, d)).withColumn("pos", F.when(F.col("px_z") > 1, -1.0).when(F.col("px_z") < -1, 1.0).otherwise(0.0))
    parts = profit_parts(F.col("pos"), F.col("ret_1"), F.col("is_gap"), static_cost(F.lit(4.0), F.lit(2.0)), F.col("funding"), W())
    return df.select("symbol", "ts", *[r6(c).alias(n) for n, c in parts.items()])


register(
    "newey_west_t",
    f"WITH {P.features_sql()}, r AS (SELECT symbol, ret_1 AS x, ret_1 - avg(ret_1) OVER (PARTITION BY symbol) AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM feat WHERE ret_1 IS NOT NULL), "
    "l AS (SELECT DISTINCT symbol, n, floor(4 * power(n / 100.0, 2.0 / 9)) AS L FROM r), g AS (SELECT l.symbol, k, any_value(L) AS L, sum(a.r * b.r) / any_value(l.n) AS c FROM l, (SELECT unnest(range(1, 40)) AS k), r a, r b WHERE k <= L AND a.symbol = l.symbol AND b.symbol = l.symbol AND b.i = a.i - k GROUP BY 1, 2), "
    f"v AS (SELECT symbol, sum(2 * (1 - k / (L + 1)) * c) AS v FROM g GROUP BY 1) SELECT r.symbol, count(*) AS n, {s6('avg(x)')} AS mean, {s6('avg(x) / sqrt(greatest(sum(r * r) / count(*) + coalesce(any_value(v.v), 0), 1e-18) / count(*))')} AS t_hac FROM r LEFT JOIN v USING (symbol) GROUP BY 1",
)(lambda spark, d: newey_west(P.features(P.cleaned(spark, d)).where("ret_1 is not null"), ["symbol"], "ret_1", "ts").select("symbol", "n", r6(F.col("mean")).alias("mean"), r6(F.col("t_hac")).alias("t_hac")))
register(
    "portfolio_agg",
    "SELECT date_trunc('month', o_orderdate) AS month, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders GROUP BY 1, 2",
)(lambda spark, d: P.table(spark, d, "orders").groupBy(F.date_trunc("MONTH", "o_orderdate").cast("timestamp_ntz").alias("month"), "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))
register(
    "edge_registry",
    "SELECT sha256(l_returnflag || '|' || l_linestatus) AS edge_id, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, count(*) AS times, round(quantile_cont(l_discount, 0.5), 6) + 0.0 AS median_effect FROM lineitem GROUP BY l_returnflag, l_linestatus",
)(
    lambda spark, d: P.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"), F.count("*").alias("times"), r6(F.percentile("l_discount", F.lit(0.5))).alias("median_effect")).select(
        F.sha2(F.concat_ws("|", "l_returnflag", "l_linestatus"), 256).alias("edge_id"), "first_seen", "last_seen", "times", "median_effect"
    )
)
register(
    "regime_metrics",
    f"WITH {P.features_sql()} SELECT CASE WHEN rv_z > 0 THEN 'high' ELSE 'low' END AS regime, count(ret_1) AS n, {s6('sum(ret_1)')} AS total, {s6('avg(ret_1) / nullif(stddev_samp(ret_1), 0)')} AS sharpe FROM feat WHERE rv_z IS NOT NULL GROUP BY 1",
)(
    lambda spark, d: P.features(P.cleaned(spark, d)).where("rv_z is not null").groupBy(F.when(F.col("rv_z") > 0, "high").otherwise("low").alias("regime")).agg(F.count("ret_1").alias("n"), r6(F.sum("ret_1")).alias("total"), r6(F.avg("ret_1") / F.nullif(F.stddev_samp("ret_1"), F.lit(0.0))).alias("sharpe"))
)
register(
    "split_assign",
    "WITH b AS (SELECT min(ts) AS a, max(ts) AS z FROM events) SELECT event_id, CASE WHEN epoch_us(ts) < epoch_us(a) + (epoch_us(z) - epoch_us(a)) * 0.6 THEN 'train' WHEN epoch_us(ts) < epoch_us(a) + (epoch_us(z) - epoch_us(a)) * 0.8 THEN 'validation' ELSE 'test' END AS split_label FROM events, b",
)(lambda spark, d: _splits(P.table(spark, d, "events")))


def _splits(e: DataFrame) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("z"))  # one row
    cut = lambda share: micros("a") + (micros("z") - micros("a")) * F.lit(share)
    return e.join(F.broadcast(ends)).select("event_id", F.when(micros("ts") < cut(0.6), "train").when(micros("ts") < cut(0.8), "validation").otherwise("test").alias("split_label"))


register(
    "src_klines",
    "SELECT event_type AS symbol, date_trunc('milliseconds', ts) AS ts, value AS close, CAST(user_id AS DOUBLE) AS volume FROM events WHERE value IS NOT NULL",
)(lambda spark, d: _klines(P.table(spark, d, "events")))


def _klines(e: DataFrame) -> DataFrame:
    """Events written as kline text rows, read back by the parser."""
    text = {"open_time": F.unix_millis(F.col("ts").cast("timestamp")), "volume": F.col("user_id")} | {c: F.col("value") for c in ("open", "high", "low", "close", "quote_volume", "taker_base_volume")}
    raw = e.select("event_type", *[c.cast("string").alias(n) for n, c in text.items()])
    return parse_klines(raw, F.col("event_type")).select("symbol", "ts", "close", "volume")


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream has written by its end: Parquet, with its checkpoint beside it, in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-stream-")
    folder = f"{base}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


_CLOSED = "HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@register("stream_bars", f"SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, struct_pack(a := ts, b := event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, struct_pack(a := ts, b := event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2 {_CLOSED.replace('HAVING date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)', 'HAVING date_trunc(' + chr(39) + 'hour' + chr(39) + ', events.ts)')}")
def stream_bars_closed(spark: SparkSession, d: str) -> DataFrame:
    """The bars that a stream over the events has closed by its end: those whose end the watermark, ten minutes behind the last event, has passed."""
    return _drained(spark, stream_bars(event_stream(spark, d)), "bars").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("stream_dedupe", "SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events")
def stream_dedupe_days(spark: SparkSession, d: str) -> DataFrame:
    """One row per user, type and day, by a stream that forgets a key 30 days behind the last event."""
    keyed = event_stream(spark, d).withColumn("day", F.date_trunc("DAY", "ts"))
    return _drained(spark, stream_dedupe(keyed, ["user_id", "event_type", "day"], "30 days"), "dedupe").select("user_id", "event_type", F.col("day").cast("timestamp_ntz").alias("day"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
