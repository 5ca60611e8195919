"""Further features and state labels of the panel: each level's columns as Column and as SQL, on chunked windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import clip, ratio
from ..functions.order_windows import OrderStat, add_level
from ..operators.align import own_rows, runs
from . import panel as P
from .panel import W, lagged, over, roll, rolling, z, zscore
from .queries import oracle_sql, queries, r6, register, s6  # noqa: F401

FEAT = f"WITH {P.features_sql()}"


def wide(spark: SparkSession, d: str, levels: list) -> DataFrame:
    """The panel with further levels of columns, worked out in the same chunks."""
    df = P.add_features(P.chunked(P.cleaned(spark, d)))
    for level in levels:
        df = add_level(df, {n: c() for n, (c, _) in level.items()}, P.KEYS)
    return own_rows(df)


def wide_sql(levels: list) -> str:
    text, last = FEAT, "feat"
    for i, level in enumerate(levels):
        text += f", w{i} AS (SELECT *, " + ", ".join(f"{t} AS {n}" for n, (_, t) in level.items()) + f" FROM {last})"
        last = f"w{i}"
    return f"{text}, wide AS (SELECT * FROM {last})"


def feature(name: str, levels: list, *out: str) -> None:
    """Registers symbol, ts and the columns of the last level (or `out`); doubles are rounded."""
    names = out or tuple(levels[-1])
    register(name, f"{wide_sql(levels)} SELECT symbol, ts, {', '.join(f'{s6(n)} AS {n}' for n in names)} FROM wide")(
        lambda spark, d: wide(spark, d, levels).select("symbol", "ts", *[r6(F.col(n)).alias(n) for n in names])
    )


def labels(name: str, levels: list, *out: str) -> None:
    """The same for columns that are no doubles."""
    names = out or tuple(levels[-1])
    register(name, f"{wide_sql(levels)} SELECT symbol, ts, {', '.join(names)} FROM wide")(lambda spark, d: wide(spark, d, levels).select("symbol", "ts", *names))


def robust_z(x: str, name: str, rows: int = 24) -> list:
    """Levels that end in the robust z of x: the frame's values clipped to its 1 and 99 % quantiles, then the distance of
    the last from their median in median absolute deviations. In Spark one ordered window, in SQL lists."""
    a, lo, hi, w, m, d = (f"{name}_{k}" for k in ("all", "lo", "hi", "cut", "mid", "mad"))
    sql = f"""(SELECT CASE WHEN len({a}) = {rows} AND {x} IS NOT NULL THEN ({w}[-1] - {m}) / (1.4826 * {d} + 1e-12) END FROM (SELECT *, list_aggregate(list_transform({w}, lambda v: abs(v - {m})), 'median') AS {d} FROM
 (SELECT *, list_aggregate({w}, 'median') AS {m} FROM (SELECT {a}, list_transform({a}, lambda v: greatest({lo}, least({hi}, v))) AS {w} FROM (SELECT {a}, list_aggregate({a}, 'quantile_cont', 0.01) AS {lo}, list_aggregate({a}, 'quantile_cont', 0.99) AS {hi})))))"""
    return [{a: (lambda: F.lit(None).cast("int"), f"list({x}) FILTER (WHERE {x} IS NOT NULL) {over(rows)}")}, {name: (lambda: OrderStat("robust_z", x, rows, rows), sql)}]


def lag(x: str, n: int) -> Column:
    return F.lag(x, n).over(W())


def pct(x: str, rows: int, least: int) -> tuple:
    """Share of the frame's values that are at most the current one, to nine decimals, and its SQL."""

    all_ = f"(list(round({x}, 9)) FILTER (WHERE {x} IS NOT NULL) {over(rows)})"
    return lambda: OrderStat("pct_rank", x, rows, least, digits=9), f"CASE WHEN len({all_}) >= {least} AND {x} IS NOT NULL THEN len(list_filter({all_}, lambda v: v <= round({x}, 9))) * 1.0 / len({all_}) END"


# --- features -----------------------------------------------------------------------------------------

feature("rolling_quantile", [{f"q{round(q * 100)}": (lambda q=q: OrderStat("quantile", "rv", 24, 24, q), roll(f"quantile_cont(?, {q})", "rv", 24, 24)) for q in (0.1, 0.25, 0.75, 0.9)}])
feature(
    "rolling_avg_rank",
    [
        {"seen": (lambda: F.lit(None).cast("int"), f"list(round(rv, 9)) FILTER (WHERE rv IS NOT NULL) {over(24)}")},
        {
            "avg_rank": (
                lambda: OrderStat("avg_rank", "rv", 24, 24, digits=9),
                "CASE WHEN len(seen) = 24 AND rv IS NOT NULL THEN (len(list_filter(seen, lambda v: v < round(rv, 9))) + (len(list_filter(seen, lambda v: v = round(rv, 9))) + 1) / 2.0) / len(seen) END",
            )
        },
    ],
)
feature("rolling_robust_z", robust_z("ret_1", "robust"))
feature(
    "mad_z",
    [
        {"rv_mid": (lambda: OrderStat("quantile", "rv", 48, 24), roll("median", "rv", 48, 24))},
        {"away": (lambda: F.abs(F.col("rv") - F.col("rv_mid")), "abs(rv - rv_mid)")},
        {"rv_mad": (lambda: OrderStat("quantile", "away", 48, 24), roll("median", "away", 48, 24))},
        {"mad_z": (lambda: ratio(F.col("rv") - F.col("rv_mid"), 1.4826 * F.col("rv_mad")), "(rv - rv_mid) / nullif(1.4826 * rv_mad, 0)")},
    ],
)
feature(
    "kyle_lambda",
    [
        {"net": (lambda: F.when(F.col("dp").isNotNull(), 2 * F.col("buy_volume") - F.col("volume")), "CASE WHEN dp IS NOT NULL THEN 2 * buy_volume - volume END")},
        {"kyle": (lambda: 1e4 / F.col("close") * F.when(F.count("net").over(W().rowsBetween(-23, 0)) >= 12, ratio(F.covar_pop("net", "dp").over(W().rowsBetween(-23, 0)), F.var_pop("net").over(W().rowsBetween(-23, 0)))), f"10000 / close * CASE WHEN count(net) {over(24)} >= 12 THEN covar_pop(net, dp) {over(24)} / nullif(var_pop(net) {over(24)}, 0) END")},
    ],
)
feature("buy_volume_proxy", [{"bought": (lambda: F.coalesce(F.nullif("buy_volume", F.lit(0.0)), F.col("volume") * (F.col("close") - F.col("low")) / F.coalesce(F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.5))), "coalesce(nullif(buy_volume, 0), volume * (close - low) / coalesce(nullif(high - low, 0), 0.5))")}])
feature("effective_spread", [{"spread_bps": (lambda: ratio(F.col("high") - F.col("low"), (F.col("high") + F.col("low")) / 2) * 1e4, "(high - low) / nullif((high + low) / 2, 0) * 10000")}])
feature("tail_move", [{"base": (lambda: OrderStat("quantile", "abs_ret", 48, 12), roll("median", "abs_ret", 48, 12))}, {"tail_move": (lambda: ratio(F.col("abs_ret"), F.col("base")), "abs_ret / nullif(base, 0)"), "range_ratio": (lambda: ratio(F.col("bar_range"), F.col("range_med48")), "bar_range / nullif(range_med48, 0)")}])
feature(
    "ts_momentum",
    [{f"m{n}": (lambda n=n: clip(ratio(F.col("close") / lag("close", n) - 1, F.col("rv") * F.sqrt(F.lit(float(n)))), -3.0, 3.0), f"CASE WHEN (close / {lagged('close', n)} - 1) / nullif(rv * sqrt({n}.0), 0) IS NOT NULL THEN greatest(-3.0, least(3.0, (close / {lagged('close', n)} - 1) / nullif(rv * sqrt({n}.0), 0))) END") for n in (5, 15, 30)}, {"ts_momentum": (lambda: (F.col("m5") + F.col("m15") + F.col("m30")) / 3, "(m5 + m15 + m30) / 3")}],
)
feature("mean_reversion_score", [{"zz": (lambda: zscore(F.col("close"), 20), z("close", 20, 20))}, {"reversion": (lambda: clip(-F.col("zz"), -4.0, 4.0), "CASE WHEN zz IS NOT NULL THEN greatest(-4.0, least(4.0, -zz)) END")}])
_CARRY = [{"fz": (lambda: zscore(F.col("funding"), 48, 24), z("funding", 48, 24)), "d_oi": (lambda: ratio(F.col("oi"), lag("oi", 1)) - 1, f"oi / nullif({lagged('oi', 1)}, 0) - 1")}, {"carry_score": (lambda: clip(-F.col("fz") - 0.5 * F.col("basis_z") - 0.25 * F.col("d_oi"), -4.0, 4.0), "CASE WHEN -fz - 0.5 * basis_z - 0.25 * d_oi IS NOT NULL THEN greatest(-4.0, least(4.0, -fz - 0.5 * basis_z - 0.25 * d_oi)) END")}]
feature("funding_carry_score", _CARRY)
feature("signed_flow_z", [{"flow": (lambda: F.signum("ret_1") * F.col("quote_volume"), "sign(ret_1) * quote_volume")}, *robust_z("flow", "flow_z")])
feature("onchain_flow", [{"netflow": (lambda: ratio((2 * F.col("buy_volume") - F.col("volume")) * lag("close", 1), F.col("oi")), f"(2 * buy_volume - volume) * {lagged('close', 1)} / nullif(oi, 0)")}, *robust_z("netflow", "net_z"), {"onchain_flow": (lambda: clip(-F.col("net_z"), -5.0, 5.0), "CASE WHEN net_z IS NOT NULL THEN greatest(-5.0, least(5.0, -net_z)) END")}])
_RANK = {"rv_rank": pct("rv", 96, 48)}
register("regime_gate", f"{wide_sql([_RANK])} SELECT symbol, ts, {s6('rv_rank')} AS rv_rank, CASE WHEN rv_rank >= 0.8 THEN 'HIGH' WHEN rv_rank <= 0.2 THEN 'LOW' WHEN rv_rank IS NOT NULL THEN 'MID' END AS gate, CASE WHEN rv_rank >= 0.8 THEN 0.6 WHEN rv_rank <= 0.2 THEN 1.2 ELSE 1.0 END AS scalar FROM wide")(
    lambda spark, d: wide(spark, d, [_RANK]).select("symbol", "ts", r6(F.col("rv_rank")).alias("rv_rank"), F.when(F.col("rv_rank") >= 0.8, "HIGH").when(F.col("rv_rank") <= 0.2, "LOW").when(F.col("rv_rank").isNotNull(), "MID").alias("gate"), F.when(F.col("rv_rank") >= 0.8, 0.6).when(F.col("rv_rank") <= 0.2, 1.2).otherwise(1.0).alias("scalar"))
)
feature("sign_consistency", [{"consistency": (lambda: F.greatest(rolling(F.when(F.col("funding") > 0, 1.0).otherwise(0.0), F.avg, 24, 24), rolling(F.when(F.col("funding") < 0, 1.0).otherwise(0.0), F.avg, 24, 24)), f"greatest({roll('avg', '(CASE WHEN funding > 0 THEN 1.0 ELSE 0.0 END)', 24, 24)}, {roll('avg', '(CASE WHEN funding < 0 THEN 1.0 ELSE 0.0 END)', 24, 24)})")}])
labels("rolling_flags", [{"any_spike": (lambda: F.max(F.coalesce(F.col("rv_z") > 2, F.lit(False))).over(W().rowsBetween(-11, 0)), f"bool_or(coalesce(rv_z > 2, FALSE)) {over(12)}"), "n_spikes": (lambda: F.sum(F.when(F.col("rv_z") > 2, 1).otherwise(0)).over(W().rowsBetween(-11, 0)), f"CAST(sum(CASE WHEN rv_z > 2 THEN 1 ELSE 0 END) {over(12)} AS BIGINT)")}])


@register(
    "global_quantile_flag",
    f"{FEAT}, q AS (SELECT symbol, quantile_cont(rv, 0.33) AS a, quantile_cont(rv, 0.67) AS b, quantile_cont(rv, 0.95) AS c FROM feat GROUP BY symbol) SELECT symbol, ts, coalesce(rv <= a, FALSE) AS low_vol, coalesce(rv > b, FALSE) AS high_vol, coalesce(rv >= c, FALSE) AS extreme_vol FROM feat JOIN q USING (symbol)",
)
def global_quantile_flag(spark: SparkSession, d: str) -> DataFrame:
    df = P.features(P.cleaned(spark, d)).select("symbol", "ts", "rv")
    edges = df.groupBy("symbol").agg(F.percentile("rv", F.array(F.lit(0.33), F.lit(0.67), F.lit(0.95))).alias("e"))
    known = lambda c: F.coalesce(c, F.lit(False))
    return df.join(edges, "symbol").select("symbol", "ts", known(F.col("rv") <= F.col("e")[0]).alias("low_vol"), known(F.col("rv") > F.col("e")[1]).alias("high_vol"), known(F.col("rv") >= F.col("e")[2]).alias("extreme_vol"))


@register(
    "qcut4",
    f"{FEAT}, q AS (SELECT symbol, quantile_cont(quote_volume, [0.25, 0.5, 0.75]) AS e FROM feat GROUP BY symbol) SELECT symbol, ts, CASE WHEN quote_volume <= e[1] THEN 0 WHEN quote_volume <= e[2] THEN 1 WHEN quote_volume <= e[3] THEN 2 ELSE 3 END AS quartile FROM feat JOIN q USING (symbol)",
)
def qcut4(spark: SparkSession, d: str) -> DataFrame:
    df = P.cleaned(spark, d).select("symbol", "ts", "quote_volume")
    edges = df.groupBy("symbol").agg(F.percentile("quote_volume", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    x = F.col("quote_volume")
    return df.join(edges, "symbol").select("symbol", "ts", F.when(x <= F.col("e")[0], 0).when(x <= F.col("e")[1], 1).when(x <= F.col("e")[2], 2).otherwise(3).alias("quartile"))


@register(
    "ewma_vol",
    f"{FEAT}, b AS (SELECT symbol, ts, coalesce(ret_1, 0) AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM feat) SELECT x.symbol, x.ts, {s6('sqrt(sum(CASE WHEN y.k > 1 THEN 0.03 * power(0.97, x.k - y.k) * y.r * y.r ELSE 0 END))')} AS ewma_vol FROM b x JOIN b y ON x.symbol = y.symbol AND y.k <= x.k GROUP BY 1, 2",
)
def ewma_vol(spark: SparkSession, d: str, block: int = 4096) -> DataFrame:
    """v[t] = 0.97 v[t-1] + 0.03 r[t]^2 with v[0] = 0, as an affine scan: a running sum in each block of bars, then what the
    blocks before leave over, which after one block of 4,096 bars is below the precision of a double."""
    df = P.features(P.cleaned(spark, d)).select("symbol", "ts", F.coalesce("ret_1", F.lit(0.0)).alias("r"))
    step = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(P.STEP_MINUTES * 60_000_000)).cast("long")
    df = df.withColumns({"block": F.floor(step / block), "place": F.pmod(step, F.lit(block)).cast("double")})
    inside = Window.partitionBy("symbol", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("own", F.sum(0.03 * F.col("r") * F.col("r") * F.pow(F.lit(0.97), -F.col("place"))).over(inside) * F.pow(F.lit(0.97), F.col("place")))
    ends = df.groupBy("symbol", "block").agg(F.max_by("own", "place").alias("carry")).select("symbol", (F.col("block") + 1).alias("block"), "carry")
    whole = F.col("own") + F.coalesce("carry", F.lit(0.0)) * F.pow(F.lit(0.97), F.col("place") + 1)
    return df.join(ends, ["symbol", "block"], "left").select("symbol", "ts", r6(F.sqrt(whole)).alias("ewma_vol"))


# --- state labels -------------------------------------------------------------------------------------


def bins(x: str, edges: list[float], top: str = "3.0") -> tuple:
    """0, 1, 2 ... by right-closed edges; null stays null."""

    def column() -> Column:
        out = F.when(F.col(x).isNull(), F.lit(None).cast("double"))
        for i, e in enumerate(edges):
            out = out.when(F.col(x) <= e, float(i))
        return out.otherwise(float(len(edges)))

    return column, f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} <= {e} THEN {float(i)}" for i, e in enumerate(edges)) + f" ELSE {float(len(edges))} END"


_STATES = [
    {"rv_rank": pct("rv", 96, 48), "liq_rank": pct("quote_volume", 24, 12), "oi_dz": (lambda: zscore(F.col("oi_delta"), 48, 24), z("oi_delta", 48, 24)), "fund_mean": (lambda: rolling(F.col("funding"), F.avg, 24, 12), roll("avg", "funding", 24, 12)),
     "fund_pos": (lambda: rolling(F.when(F.col("funding") > 0, 1.0).when(F.col("funding").isNotNull(), 0.0), F.avg, 24, 12), roll("avg", "(CASE WHEN funding > 0 THEN 1.0 WHEN funding IS NOT NULL THEN 0.0 END)", 24, 12)),
     "fund_neg": (lambda: rolling(F.when(F.col("funding") < 0, 1.0).when(F.col("funding").isNotNull(), 0.0), F.avg, 24, 12), roll("avg", "(CASE WHEN funding < 0 THEN 1.0 WHEN funding IS NOT NULL THEN 0.0 END)", 24, 12))},
    {"rv_rank100": (lambda: 100 * F.col("rv_rank"), "100 * rv_rank")},
    {"vol_regime": bins("rv_rank", [0.33, 0.66]), "ms_vol": bins("rv_rank100", [33.0, 66.0, 95.0]), "ms_liq": bins("liq_rank", [0.2, 0.8]), "ms_oi": bins("oi_dz", [-1.5, 1.5]),
     "ms_funding": (lambda: F.when(F.col("fund_mean").isNull(), F.lit(None).cast("double")).when(F.abs("fund_mean") >= 0.0002, 2.0).when(F.greatest("fund_pos", "fund_neg") >= 0.7, 1.0).otherwise(0.0), "CASE WHEN fund_mean IS NULL THEN NULL WHEN abs(fund_mean) >= 0.0002 THEN 2.0 WHEN greatest(fund_pos, fund_neg) >= 0.7 THEN 1.0 ELSE 0.0 END")},
    {"state_code": (lambda: 1000 * F.coalesce("ms_vol", F.lit(0.0)) + 100 * F.coalesce("ms_liq", F.lit(0.0)) + 10 * F.coalesce("ms_oi", F.lit(0.0)) + F.coalesce("ms_funding", F.lit(0.0)), "1000 * coalesce(ms_vol, 0) + 100 * coalesce(ms_liq, 0) + 10 * coalesce(ms_oi, 0) + coalesce(ms_funding, 0)")},
]
for _n, _c in {"state_vol_regime": "vol_regime", "state_ms_vol": "ms_vol", "state_ms_liq": "ms_liq", "state_ms_oi": "ms_oi", "state_ms_funding": "ms_funding", "state_code": "state_code"}.items():
    feature(_n, _STATES, _c)

_true = lambda c: F.coalesce(c, F.lit(False))
#: State masks; the ones of other states are told by a word in their name.
MASKS = {
    "low_liquidity": (lambda: _true(F.col("liq_rank") <= 0.2), "coalesce(liq_rank <= 0.2, FALSE)"),
    "spread_elevated": (lambda: _true(F.col("spread_z") >= 1.5), "coalesce(spread_z >= 1.5, FALSE)"),
    "refill_lag": (lambda: F.max(_true(F.col("liq_rank") <= 0.2)).over(W().rowsBetween(-5, 0)), f"bool_or(coalesce(liq_rank <= 0.2, FALSE)) {over(6)}"),
    "aftershock": (lambda: F.max(_true(F.col("rv_z") >= 2)).over(W().rowsBetween(-11, 0)) & _true(F.col("rv_z") < 2), f"bool_or(coalesce(rv_z >= 2, FALSE)) {over(12)} AND coalesce(rv_z < 2, FALSE)"),
    "compression": (lambda: _true(F.col("ratio_now") <= 0.8), "coalesce(ratio_now <= 0.8, FALSE)"),
    "high_vol": (lambda: _true(F.col("rv_rank") > 0.66), "coalesce(rv_rank > 0.66, FALSE)"),
    "low_vol": (lambda: _true(F.col("rv_rank") <= 0.33), "coalesce(rv_rank <= 0.33, FALSE)"),
    "crowding": (lambda: _true(F.col("oi_z") >= 1.5) & _true(F.abs("funding") >= 0.0002), "coalesce(oi_z >= 1.5, FALSE) AND coalesce(abs(funding) >= 0.0002, FALSE)"),
    "funding_persistence": (lambda: _true(F.greatest("fund_pos", "fund_neg") >= 0.7), "coalesce(greatest(fund_pos, fund_neg) >= 0.7, FALSE)"),
    "deleveraging": (lambda: _true(F.col("oi_delta") < 0) & _true(F.col("rv_z") >= 1), "coalesce(oi_delta < 0, FALSE) AND coalesce(rv_z >= 1, FALSE)"),
}
labels("state_masks", [_STATES[0], MASKS])
#: Words in a state's name, first match wins -> the mask that stands for it.
WORDS = {"VOL": "high_vol", "LIQ": "low_liquidity", "SPREAD": "spread_elevated", "COMPRESS": "compression", "FUNDING": "funding_persistence", "OI": "deleveraging"}
STATE_IDS = ["POST_VOL_STATE", "THIN_LIQ_BOOK", "SPREAD_WIDE_STATE", "COMPRESSED_STATE", "FUNDING_SKEW_STATE", "OI_UNWIND_STATE"]
_BY_WORD = {s: next(m for w, m in WORDS.items() if w in s) for s in STATE_IDS}
register("state_fallback", wide_sql([_STATES[0], MASKS]) + " " + " UNION ALL ".join(f"SELECT symbol, ts, '{s}' AS state_id FROM wide WHERE {m}" for s, m in _BY_WORD.items()))(
    lambda spark, d: wide(spark, d, [_STATES[0], MASKS]).select("symbol", "ts", F.explode(F.array_compact(F.array(*[F.when(F.col(m), F.lit(s)) for s, m in _BY_WORD.items()]))).alias("state_id"))
)
labels("bull_bear", [{"mid": (lambda: rolling(F.col("close"), F.avg, 24, 12), roll("avg", "close", 24, 12)), "slow": (lambda: rolling(F.col("close"), F.avg, 48, 24), roll("avg", "close", 48, 24))}, {"side": (lambda: F.when(F.col("close") >= F.col("mid"), "bull").when(F.col("close") < F.col("mid"), "bear").otherwise("flat"), "CASE WHEN close >= mid THEN 'bull' WHEN close < mid THEN 'bear' ELSE 'flat' END"), "htf_trend": (lambda: F.signum(F.round(F.col("slow") - lag("slow", 12), 9)).cast("int"), f"CAST(sign(round(slow - {lagged('slow', 12)}, 9)) AS INTEGER)")}])


@register(
    "funding_regime",
    f"{wide_sql([{'f8': (None, roll('avg', 'funding', 8, 4))}])}, q AS (SELECT symbol, quantile_cont(f8, 0.33) AS a, quantile_cont(f8, 0.67) AS b FROM wide GROUP BY symbol) SELECT symbol, ts, CASE WHEN round(f8, 9) <= round(a, 9) THEN 'low' WHEN round(f8, 9) <= round(b, 9) THEN 'mid' WHEN f8 IS NOT NULL THEN 'high' ELSE 'unknown' END AS funding_regime FROM wide JOIN q USING (symbol)",
)
def funding_regime(spark: SparkSession, d: str) -> DataFrame:
    df = wide(spark, d, [{"f8": (lambda: rolling(F.col("funding"), F.avg, 8, 4), "")}]).select("symbol", "ts", "f8")
    edges = df.groupBy("symbol").agg(F.percentile("f8", F.array(F.lit(0.33), F.lit(0.67))).alias("e"))
    x, cut = F.round("f8", 9), lambda i: F.round(F.col("e")[i], 9)
    return df.join(edges, "symbol").select("symbol", "ts", F.when(x <= cut(0), "low").when(x <= cut(1), "mid").when(F.col("f8").isNotNull(), "high").otherwise("unknown").alias("funding_regime"))


_HOT = [{"fund_abs_rank": pct("abs_funding", 96, 48)}, {"hot": (lambda: _true(F.col("fund_abs_rank") >= 0.7), "coalesce(fund_abs_rank >= 0.7, FALSE)")}]


@register(
    "funding_persistence_state",
    f"{wide_sql(_HOT)}, g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, hot ORDER BY ts) AS g FROM wide), "
    "r AS (SELECT *, count(*) OVER (PARTITION BY symbol, hot, g) AS n, row_number() OVER (PARTITION BY symbol, hot, g ORDER BY ts) AS age FROM g) "
    f"SELECT symbol, ts, CAST(age AS INTEGER) AS age, min(ts) OVER w AS enter_ts, max(ts) OVER w AS exit_ts, {s6('max(abs_funding) OVER w')} AS severity FROM r WHERE hot AND n >= 3 WINDOW w AS (PARTITION BY symbol, g)",
)
def funding_persistence_state(spark: SparkSession, d: str, least: int = 3) -> DataFrame:
    df = runs(wide(spark, d, _HOT), F.col("hot"), ["symbol"]).where(F.col("hot") & (F.col("run_length") >= least))
    run = Window.partitionBy("symbol", "run_id")
    return df.select("symbol", "ts", F.row_number().over(run.orderBy("ts")).alias("age"), F.min("ts").over(run).alias("enter_ts"), F.max("ts").over(run).alias("exit_ts"), r6(F.max("abs_funding").over(run)).alias("severity"))
