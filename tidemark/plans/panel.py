"""Hourly bars and features from the events table, in DataFrame form and as DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import frames
from ..functions.frames import clip, ratio
from ..functions.order_windows import OrderStat, add_level
from ..operators.align import grid_reindex, own_rows, time_chunks

#: Windows of the panel run over chunks of a symbol's history, each with what it needs of its neighbours.
KEYS = ("symbol", "_chunk")
W = partial(frames.ordered, KEYS)
rolling, zscore = partial(frames.rolling, keys=KEYS), partial(frames.zscore, keys=KEYS)
#: Bars in a chunk, and before and after it: no feature, threshold or rule looks back further than BEFORE bars.
CHUNK, BEFORE, AFTER = 8192, 640, 64
STEP_MINUTES = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, high, low, close, volume of each event type and hour that has events."""
    e = table(spark, sf_dir, "events").where("value is not null")
    order = F.struct("ts", "event_id")
    even, buy = F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count("*").cast("double").alias("volume"),
        F.sum("value").alias("quote_volume"),
        F.sum(F.when(buy, 1.0).otherwise(0.0)).alias("buy_volume"),
        F.avg(F.when(even, F.col("value"))).alias("venue_a"),
        F.avg(F.when(~even, F.col("value"))).alias("venue_b"),
    ).withColumnRenamed("hour", "ts")


BARS_SQL = """bars AS (SELECT e.event_type AS symbol, date_trunc('hour', e.ts) AS ts,
 first(e.value ORDER BY e.ts, e.event_id) AS open, max(e.value) AS high, min(e.value) AS low,
 last(e.value ORDER BY e.ts, e.event_id) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(e.value) AS quote_volume,
 sum(CASE WHEN e.user_id % 3 = 0 THEN 1.0 ELSE 0.0 END) AS buy_volume,
 avg(CASE WHEN e.user_id % 2 = 0 THEN e.value END) AS venue_a, avg(CASE WHEN e.user_id % 2 <> 0 THEN e.value END) AS venue_b
 FROM events e WHERE e.value IS NOT NULL GROUP BY 1, 2)"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars on the full hourly grid: prices missing in a gap, volumes 0, is_gap."""
    g = grid_reindex(bars(spark, sf_dir), ["symbol"], "1 hour")
    return g.withColumns({"is_gap": F.col("close").isNull()} | {c: F.coalesce(c, F.lit(0.0)) for c in ("volume", "quote_volume", "buy_volume")})


def numbered(df: DataFrame) -> DataFrame:
    """Adds the bar's number in its symbol, from 1, by time alone (the grid has no holes), and n_bars, the symbol's bars.

    The first time of a symbol is one aggregate, joined back, so no symbol's history is sorted in one place.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    first = df.groupBy("symbol").agg(F.min("ts").alias("_a"), F.count("*").alias("n_bars"))
    return df.join(first, "symbol").withColumn("bar", ((micros(F.col("ts")) - micros(F.col("_a"))) / F.lit(STEP_MINUTES * 60_000_000)).cast("long") + 1).drop("_a")


CLEANED_SQL = (
    BARS_SQL
    + """, grid AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars GROUP BY symbol),
cleaned AS (SELECT g.symbol, g.ts, b.open, b.high, b.low, b.close, coalesce(b.volume, 0.0) AS volume, coalesce(b.quote_volume, 0.0) AS quote_volume,
 coalesce(b.buy_volume, 0.0) AS buy_volume, b.venue_a, b.venue_b, b.close IS NULL AS is_gap FROM grid g LEFT JOIN bars b ON b.symbol = g.symbol AND b.ts = g.ts)"""
)


def over(rows: int, lag: int = 0) -> str:
    end = f"{lag} PRECEDING" if lag else "CURRENT ROW"
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {rows - 1 + lag} PRECEDING AND {end})"


def roll(f: str, x: str, rows: int, least: int, lag: int = 0) -> str:
    call = f.replace("?", x) if "?" in f else f"{f}({x})"
    return f"(CASE WHEN count({x}) {over(rows, lag)} >= {least} THEN {call} {over(rows, lag)} END)"


def z(x: str, rows: int, least: int) -> str:
    return f"(({x} - {roll('avg', x, rows, least)}) / nullif({roll('stddev_samp', x, rows, least)}, 0))"


def lagged(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY ts)"


def filled(name: str, limit: int = 48) -> Column:
    """The value, else the last one of `limit` bars, else the next one of `limit` bars."""
    before, after = F.last(name, ignorenulls=True).over(W().rowsBetween(-limit, 0)), F.first(name, ignorenulls=True).over(W().rowsBetween(0, limit))
    return F.coalesce(before, after)


def filled_sql(name: str, limit: int = 48) -> str:
    order = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN"
    return f"coalesce(last_value({name} IGNORE NULLS) {order} {limit} PRECEDING AND CURRENT ROW), first_value({name} IGNORE NULLS) {order} CURRENT ROW AND {limit} FOLLOWING))"


#: Features in order of dependence; each as a function that makes the Column and as SQL over the columns before it.
LEVELS: list[dict[str, tuple[Callable[[], Column], str]]] = [
    {
        "ret_1": (lambda: ratio(F.col("close"), F.lag("close", 1).over(W())) - 1, f"close / nullif({lagged('close', 1)}, 0) - 1"),
        "ret_12": (lambda: ratio(F.col("close"), F.lag("close", 12).over(W())) - 1, f"close / nullif({lagged('close', 12)}, 0) - 1"),
        "trend": (lambda: ratio(F.col("close"), F.lag("close", 24).over(W())) - 1, f"close / nullif({lagged('close', 24)}, 0) - 1"),
        "logret": (lambda: F.log(F.col("close")) - F.log(F.lag("close", 1).over(W())), f"ln(close) - ln({lagged('close', 1)})"),
        "bar_range": (lambda: ratio(F.col("high") - F.col("low"), F.col("close")), "(high - low) / nullif(close, 0)"),
        "wick": (lambda: ratio(F.abs(F.col("high") - F.col("close")) + F.abs(F.col("close") - F.col("low")), F.col("close")), "(abs(high - close) + abs(close - low)) / nullif(close, 0)"),
        "basis": (lambda: ratio(F.col("venue_a"), F.col("venue_b")) - 1, "venue_a / nullif(venue_b, 0) - 1"),
        "funding": (lambda: (ratio(F.col("buy_volume"), F.col("volume")) - F.lit(0.33)) * F.lit(0.001), "(buy_volume / nullif(volume, 0) - 0.33) * 0.001"),
        "oi": (lambda: rolling(F.col("volume"), F.sum, 48, 1), roll("sum", "volume", 48, 1)),
        "high_24": (lambda: rolling(F.col("high"), F.max, 24, 18), roll("max", "high", 24, 18)),
        "low_24": (lambda: rolling(F.col("low"), F.min, 24, 18), roll("min", "low", 24, 18)),
        "vol_med": (lambda: OrderStat("quantile", "quote_volume", 48, 24), roll("quantile_cont(?, 0.5)", "quote_volume", 48, 24)),
        "range_med48": (lambda: OrderStat("quantile", "bar_range", 48, 24), roll("quantile_cont(?, 0.5)", "((high - low) / nullif(close, 0))", 48, 24)),
        "top_24": (lambda: rolling(F.col("close"), F.max, 24, 6, 1), roll("max", "close", 24, 6, 1)),
        "bottom_24": (lambda: rolling(F.col("close"), F.min, 24, 6, 1), roll("min", "close", 24, 6, 1)),
        "top_48": (lambda: rolling(F.col("high"), F.max, 48, 16, 1), roll("max", "high", 48, 16, 1)),
        "bottom_48": (lambda: rolling(F.col("low"), F.min, 48, 16, 1), roll("min", "low", 48, 16, 1)),
        "mean_24": (lambda: rolling(F.col("close"), F.avg, 24, 6), roll("avg", "close", 24, 6)),
        "sd_24": (lambda: F.nullif(rolling(F.col("close"), F.stddev_samp, 24, 6), F.lit(0.0)), f"nullif({roll('stddev_samp', 'close', 24, 6)}, 0)"),
        "vpin": (lambda: ratio(rolling(F.abs(2 * F.col("buy_volume") - F.col("volume")), F.sum, 24), rolling(F.col("volume"), F.sum, 24)), f"{roll('sum', 'abs(2 * buy_volume - volume)', 24, 24)} / nullif({roll('sum', 'volume', 24, 24)}, 0)"),
    },
    {
        "abs_ret": (lambda: F.abs("ret_1"), "abs(ret_1)"),
        "ret_mean_3": (lambda: rolling(F.col("ret_1"), F.avg, 3, 1), roll("avg", "ret_1", 3, 1)),
        "prev_high": (lambda: F.lag("high_24", 1).over(W()), lagged("high_24", 1)),
        "prev_low": (lambda: F.lag("low_24", 1).over(W()), lagged("low_24", 1)),
        "vol_base": (lambda: filled("vol_med"), filled_sql("vol_med")),
        "range_base": (lambda: filled("range_med48"), filled_sql("range_med48")),
        "abs_trend": (lambda: F.abs("trend"), "abs(trend)"),
        "rv": (lambda: rolling(F.col("logret"), F.stddev_samp, 24, 18), roll("stddev_samp", "logret", 24, 18)),
        "px_z": (lambda: zscore(F.col("ret_12"), 48, 24), z("ret_12", 48, 24)),
        "spread_z": (lambda: zscore(F.col("bar_range"), 48, 24), z("bar_range", 48, 24)),
        "basis_z": (lambda: zscore(F.col("basis"), 48, 16), z("basis", 48, 16)),
        "oi_delta": (lambda: F.col("oi") - F.lag("oi", 12).over(W()), f"oi - {lagged('oi', 12)}"),
        "oi_logdiff": (lambda: F.log("oi") - F.log(F.lag("oi", 1).over(W())), f"ln(oi) - ln({lagged('oi', 1)})"),
        "range_24": (lambda: ratio(F.col("high_24") - F.col("low_24"), F.col("close")), "(high_24 - low_24) / nullif(close, 0)"),
        "amihud": (lambda: rolling(ratio(F.abs("logret"), F.col("quote_volume")), F.avg, 24), roll("avg", "(abs(logret) / nullif(quote_volume, 0))", 24, 24)),
        "dp": (lambda: F.col("close") - F.lag("close", 1).over(W()), f"close - {lagged('close', 1)}"),
    },
    {
        "broke": (lambda: F.when((F.col("close") > F.col("prev_high")) | (F.col("close") < F.col("prev_low")), 1).otherwise(0), "CASE WHEN close > prev_high OR close < prev_low THEN 1 ELSE 0 END"),
        "rv_z": (lambda: zscore(F.col("rv"), 72, 24), z("rv", 72, 24)),
        "oi_z": (lambda: zscore(F.col("oi_logdiff"), 48, 24), z("oi_logdiff", 48, 24)),
        "range_med": (lambda: OrderStat("quantile", "range_24", 96, 48), roll("quantile_cont(?, 0.5)", "range_24", 96, 48)),
        "abs_spread_z": (lambda: F.abs("spread_z"), "abs(spread_z)"),
        "abs_basis_z": (lambda: F.abs("basis_z"), "abs(basis_z)"),
        "abs_px_z": (lambda: F.abs("px_z"), "abs(px_z)"),
        "basis_step": (lambda: F.abs(F.col("basis_z") - F.lag("basis_z", 1).over(W())), f"abs(basis_z - {lagged('basis_z', 1)})"),
        "dp_1": (lambda: F.lag("dp", 1).over(W()), lagged("dp", 1)),
        "trend_step": (lambda: F.col("abs_trend") - F.lag("abs_trend", 3).over(W()), f"abs_trend - {lagged('abs_trend', 3)}"),
        "abs_funding": (lambda: F.abs("funding"), "abs(funding)"),
        "score": (lambda: clip(-F.col("px_z"), -4.0, 4.0), "CASE WHEN px_z IS NOT NULL THEN greatest(-4.0, least(4.0, -px_z)) END"),
    },
    {
        "broke_before": (lambda: F.max("broke").over(W().rowsBetween(-3, -1)), "max(broke) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"),
        "rv_step": (lambda: F.abs(F.col("rv_z") - F.lag("rv_z", 1).over(W())), f"abs(rv_z - {lagged('rv_z', 1)})"),
        "ratio_now": (lambda: ratio(F.col("range_24"), F.col("range_med")), "range_24 / nullif(range_med, 0)"),
        "roll_spread": (lambda: 2 * F.sqrt(F.greatest(F.lit(0.0), -F.when(F.count(F.col("dp") * F.col("dp_1")).over(W().rowsBetween(-23, 0)) >= 24, F.covar_samp("dp", "dp_1").over(W().rowsBetween(-23, 0))))),
            f"2 * sqrt(greatest(0.0, -CASE WHEN count(dp * dp_1) {over(24)} >= 24 THEN covar_samp(dp, dp_1) {over(24)} END))",
        ),
    },
]


def chunked(df: DataFrame, chunk: int = CHUNK, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """The panel's bars with `_chunk`, each bar also in the chunks that look back or ahead to it; `own_rows` takes these off."""
    return time_chunks(df, STEP_MINUTES * 60, chunk, before, after)


def add_features(df: DataFrame) -> DataFrame:
    """Features of a chunked panel."""
    for level in LEVELS:
        df = add_level(df, {name: column() for name, (column, _) in level.items()}, KEYS)
    return df


def features(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    return own_rows(add_features(chunked(df, chunk)))


def features_sql() -> str:
    out, last = [], "cleaned"
    for i, level in enumerate(LEVELS):
        out.append(f"f{i} AS (SELECT *, " + ", ".join(f"{text} AS {name}" for name, (_, text) in level.items()) + f" FROM {last})")
        last = f"f{i}"
    return CLEANED_SQL + ", " + ", ".join(out) + f", feat AS (SELECT * FROM {last})"


#: Past-only thresholds of the detectors: quantile of the 96 bars before, from 24 values on.
THRESHOLDS: dict[str, list[float]] = {
    "spread_z": [0.8, 0.9, 0.93, 0.97], "rv_z": [0.5, 0.7, 0.9, 0.95, 0.97], "abs_ret": [0.3, 0.35, 0.4, 0.75, 0.9, 0.95, 0.99, 0.995], "wick": [0.97],
    "rv_step": [0.98], "abs_funding": [0.6], "oi_delta": [0.05], "abs_trend": [0.35, 0.7, 0.75, 0.85], "rv": [0.33, 0.35, 0.5, 0.6, 0.66, 0.7],
    "trend_step": [0.1, 0.9], "bar_range": [0.8, 0.9], "abs_px_z": [0.95, 0.96], "abs_basis_z": [0.85, 0.92, 0.93, 0.97], "abs_spread_z": [0.8], "basis_step": [0.99],
}


def pq(name: str, q: float) -> str:
    return f"{name}_pq{round(q * 1000)}"


def thresholds(df: DataFrame, rows: int = 96, least: int = 24) -> DataFrame:
    """A chunked panel with its thresholds, by pandas' rolling quantiles in each chunk (at most CHUNK + BEFORE + AFTER bars).

    An exact percentile over a sliding frame sorts the frame anew for each bar; the rolling form moves one value in and
    one out.
    """
    new = [T.StructField(pq(x, q), T.DoubleType()) for x, qs in THRESHOLDS.items() for q in qs]

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("ts")
        found = {}
        for x, qs in THRESHOLDS.items():
            past = bars[x].shift(1).rolling(rows, min_periods=least)
            found |= {pq(x, q): past.quantile(q) for q in qs}
        return pd.concat([bars, pd.DataFrame(found, index=bars.index)], axis=1)

    return df.groupBy(*KEYS).applyInPandas(run, T.StructType([*df.schema.fields, *new]))


def thresholds_sql() -> str:
    past = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING)"
    parts = [f"CASE WHEN count({x}) {past} >= 24 THEN quantile_cont({x}, {q}) {past} END AS {pq(x, q)}" for x, qs in THRESHOLDS.items() for q in qs]
    return f"thr AS (SELECT *, {', '.join(parts)} FROM feat)"
