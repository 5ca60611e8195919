"""Events with a beginning and an end, their metrics, and the registry of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import ordered, ratio
from ..functions.order_windows import OrderStat
from ..operators.align import active_on_grid, asof_join, keep_one, runs
from ..operators.greedy import cool_down, space_out
from ..operators.lineage import durable
from . import panel as P
from .more_features import FEAT, _true, pct, wide, wide_sql
from .panel import lagged, numbered, over, roll, rolling
from .queries import _HITS_SQL, _KEPT_SQL, detect, oracle_sql, queries, r6, register, s6  # noqa: F401

S = ordered  # whole histories, for sparse rows and running minima
_BAR = "row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar"


def cooled_sql(wait: int, keys: str = "symbol") -> str:
    """Greedy cool-down over `spans` (keys, bar, leave), bar by bar."""
    same = " AND ".join(f"s.{k} = k.{k}" for k in keys.split(", "))
    own, k = ", ".join(f"k.{c}" for c in keys.split(", ")), keys
    return f"""kept AS (SELECT {k}, min(bar) AS bar FROM spans GROUP BY {k}
 UNION ALL SELECT {own}, min(s.bar) FROM (SELECT j.*, t.leave FROM kept j JOIN spans t USING ({k}, bar)) k JOIN spans s ON {same} AND s.bar > k.leave + {wait} GROUP BY {own}, k.bar)"""


def spaced(name: str, levels: list, rules: dict[str, tuple[Column, str]], gap: int) -> None:
    """Registers the spaced hits of rules over further levels of the panel."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        df = numbered(wide(spark, d, levels))
        names = F.array_compact(F.array(*[F.when(_true(c()), F.lit(n)) for n, (c, _) in rules.items()]))
        hits = df.select("symbol", "ts", "bar", F.explode(names).alias("event_type"))
        return space_out(hits, ["event_type", "symbol"], "bar", gap).select("event_type", "symbol", "ts", "bar")

    sql = wide_sql(levels).replace("WITH ", "WITH RECURSIVE ", 1) + f", b AS (SELECT *, {_BAR} FROM wide), spans AS (" + " UNION ALL ".join(f"SELECT '{n}' AS event_type, symbol, ts, bar, bar AS leave FROM b WHERE {t}" for n, (_, t) in rules.items()) + ")"
    register(name, f"{sql}, {cooled_sql(gap - 1, 'event_type, symbol')} SELECT s.event_type, s.symbol, s.ts, s.bar FROM spans s JOIN kept USING (event_type, symbol, bar)")(f)


def lag(x: str, n: int) -> Column:
    return F.lag(x, n).over(P.W())


# --- funding -------------------------------------------------------------------------------------------

_FUND = [
    {"f_pct": pct("abs_funding", 96, 48), "rise": (lambda: F.when(F.col("abs_funding") > lag("abs_funding", 12), F.col("abs_funding") - lag("abs_funding", 12)), f"CASE WHEN abs_funding > {lagged('abs_funding', 12)} THEN abs_funding - {lagged('abs_funding', 12)} END")},
    {"a_pct": pct("rise", 96, 12), "f_was": (lambda: lag("f_pct", 1), lagged("f_pct", 1)), "hot": (lambda: _true(F.col("f_pct") >= 0.7), "coalesce(f_pct >= 0.7, FALSE)"), "extreme": (lambda: F.max(_true(F.col("f_pct") >= 0.9)).over(P.W().rowsBetween(-23, 0)), f"bool_or(coalesce(f_pct >= 0.9, FALSE)) {over(24)}")},
    {"a_was": (lambda: lag("a_pct", 1), lagged("a_pct", 1)), "third": (lambda: F.col("hot") & _true(lag("hot", 1)) & _true(lag("hot", 2)) & ~_true(lag("hot", 3)), f"hot AND coalesce({lagged('hot', 1)}, FALSE) AND coalesce({lagged('hot', 2)}, FALSE) AND NOT coalesce({lagged('hot', 3)}, FALSE)")},
]
spaced(
    "detect_funding",
    _FUND,
    {
        "FUNDING_EXTREME_ONSET": (lambda: (F.col("f_pct") >= 0.9) & (F.col("f_was") < 0.9), "f_pct >= 0.9 AND f_was < 0.9"),
        "FUNDING_PERSISTENCE_TRIGGER": (lambda: F.col("third") | _true((F.col("a_pct") >= 0.9) & (F.col("a_was") < 0.9)), "third OR coalesce(a_pct >= 0.9 AND a_was < 0.9, FALSE)"),
        "FUNDING_NORMALIZATION_TRIGGER": (lambda: (F.col("f_pct") <= 0.5) & (F.col("f_was") > 0.5) & F.col("extreme"), "f_pct <= 0.5 AND f_was > 0.5 AND extreme"),
    },
    12,
)

# --- volatility shock ------------------------------------------------------------------------------------

_SHOCK = [
    {"rv6": (lambda: rolling(F.col("logret"), F.stddev_samp, 6, 4), roll("stddev_samp", "logret", 6, 4))},
    {"rv_base": (lambda: OrderStat("quantile", "rv6", 48, 24, 0.5), roll("median", "rv6", 48, 24))},
    {"shock": (lambda: F.round(ratio(F.col("rv6"), F.col("rv_base")), 9), "round(rv6 / nullif(rv_base, 0), 9)")},
    {"was": (lambda: lag("shock", 1), lagged("shock", 1)), "calm": (lambda: F.sum(F.when(F.col("shock") <= 1.25, 1).otherwise(0)).over(P.W().rowsBetween(-2, 0)) == 3, f"sum(CASE WHEN shock <= 1.25 THEN 1 ELSE 0 END) {over(3)} = 3")},
]


@register(
    "detect_vol_shock",
    wide_sql(_SHOCK).replace("WITH ", "WITH RECURSIVE ", 1)
    + f", b AS (SELECT *, {_BAR}, round(quantile_cont(shock, 0.95) OVER (PARTITION BY symbol), 9) AS limit_, count(*) OVER (PARTITION BY symbol) AS n_bars FROM wide), "
    "spans AS (SELECT symbol, bar, coalesce((SELECT min(c.bar) FROM b c WHERE c.symbol = b.symbol AND c.bar >= b.bar AND c.calm), n_bars) AS leave, ts, rv_base FROM b WHERE shock >= limit_ AND was < limit_), "
    + cooled_sql(6)
    + f" SELECT k.symbol, k.bar, s.leave, {s6('max(b.rv6)')} AS rv_peak, arg_min(b.bar, struct_pack(a := -coalesce(b.rv6, 0), b := b.bar)) - k.bar AS t_rv_peak, {s6('sum(CASE WHEN b.rv6 > s.rv_base THEN b.rv6 - s.rv_base ELSE 0 END)')} AS excess FROM kept k JOIN spans s USING (symbol, bar) JOIN b ON b.symbol = k.symbol AND b.bar BETWEEN k.bar AND s.leave GROUP BY 1, 2, 3",
)
def detect_vol_shock(spark: SparkSession, d: str) -> DataFrame:
    """Onsets of rv6 over its 48-bar median at the symbol's 95 % quantile, to the third calm bar in a row; metrics over the episode.

    The calm bar is a running minimum from the end, and the bars of an episode are the ones of the interval flags, so no
    bar meets another symbol's or a later episode.
    """
    df = durable(numbered(wide(spark, d, _SHOCK)).select("symbol", "ts", "bar", "n_bars", "rv6", "rv_base", "shock", "was", "calm"))
    limits = df.groupBy("symbol").agg(F.round(F.percentile("shock", F.lit(0.95)), 9).alias("limit_"))
    ahead = S().rowsBetween(0, Window.unboundedFollowing)
    df = df.join(F.broadcast(limits), "symbol").withColumn("leave", F.coalesce(F.min(F.when(F.col("calm"), F.col("bar"))).over(ahead), F.col("n_bars")))
    spans = df.where((F.col("shock") >= F.col("limit_")) & (F.col("was") < F.col("limit_"))).select("symbol", "bar", "leave", F.col("rv_base").alias("base"))
    kept = cool_down(spans, ["symbol"], "bar", "leave", 6)
    bars = df.select("symbol", F.col("bar").alias("at"), "rv6")
    # the last episode begun at or before a bar: its own, as kept episodes do not overlap
    inside = asof_join(bars, kept.withColumnRenamed("bar", "at"), ["symbol"], on="at", right_time="enter").where(F.col("at") <= F.col("leave"))
    g = inside.groupBy("symbol", F.col("enter").alias("bar"), "leave").agg(
        F.max("rv6").alias("rv_peak"), F.min_by("at", F.struct(-F.coalesce("rv6", F.lit(0.0)), "at")).alias("top"), F.sum(F.when(F.col("rv6") > F.col("base"), F.col("rv6") - F.col("base")).otherwise(0.0)).alias("excess")
    )
    return g.select("symbol", "bar", "leave", r6(F.col("rv_peak")).alias("rv_peak"), (F.col("top") - F.col("bar")).alias("t_rv_peak"), r6(F.col("excess")).alias("excess"))


# --- liquidity -------------------------------------------------------------------------------------------

_VACUUM = [{"thin": (lambda: _true((F.col("quote_volume") < 0.9 * F.col("vol_med")) & (F.col("bar_range") > 0.7 * F.col("range_med48"))), "coalesce(quote_volume < 0.9 * vol_med AND bar_range > 0.7 * range_med48, FALSE)"), "was": (lambda: lag("abs_ret", 1), lagged("abs_ret", 1))}]
_VACUUM_SQL = wide_sql(_VACUUM).replace("WITH ", "WITH RECURSIVE ", 1) + f", b AS (SELECT *, {_BAR}, count(*) OVER (PARTITION BY symbol) AS n_bars FROM wide)"


@register(
    "detect_liquidity_vacuum",
    f"{_VACUUM_SQL}, q AS (SELECT symbol, quantile_cont(abs_ret, 0.8) AS cut FROM b GROUP BY 1), n AS (SELECT b.*, cut, coalesce((SELECT min(c.bar) FROM b c WHERE c.symbol = b.symbol AND c.bar > b.bar AND NOT c.thin), n_bars + 1) AS stop FROM b JOIN q USING (symbol)), "
    f"spans AS (SELECT symbol, bar, least(stop - 1, bar + 96) AS leave FROM n WHERE abs_ret >= cut AND was < cut AND stop - bar - 1 >= 1), {cooled_sql(4)} SELECT symbol, bar + 1 AS enter_bar, leave AS exit_bar, leave - bar AS duration FROM kept JOIN spans USING (symbol, bar)",
)
def detect_liquidity_vacuum(spark: SparkSession, d: str, least: int = 1, most: int = 96) -> DataFrame:
    """A jump of the return over the symbol's threshold, followed at once by bars of thin volume and wide range."""
    df = durable(numbered(wide(spark, d, _VACUUM)).select("symbol", "ts", "bar", "n_bars", "abs_ret", "was", "thin"))
    cuts = df.groupBy("symbol").agg(F.percentile("abs_ret", F.lit(0.8)).alias("cut"))
    stop = F.coalesce(F.min(F.when(~F.col("thin"), F.col("bar"))).over(S().rowsBetween(1, Window.unboundedFollowing)), F.col("n_bars") + 1)
    df = df.join(F.broadcast(cuts), "symbol").withColumn("stop", stop)
    spans = df.where((F.col("abs_ret") >= F.col("cut")) & (F.col("was") < F.col("cut")) & (F.col("stop") - F.col("bar") - 1 >= least)).select("symbol", "bar", F.least(F.col("stop") - 1, F.col("bar") + most).alias("leave"))
    return cool_down(spans, ["symbol"], "bar", "leave", 4).select("symbol", (F.col("bar") + 1).alias("enter_bar"), F.col("leave").alias("exit_bar"), (F.col("leave") - F.col("bar")).alias("duration"))


_CASCADE = [{"hit": (lambda: _true((F.col("quote_volume") > 1.2 * F.col("vol_med")) & (F.col("quote_volume") > 100) & (F.col("oi_delta") < 0)), "coalesce(quote_volume > 1.2 * vol_med AND quote_volume > 100 AND oi_delta < 0, FALSE)"), "oi_was": (lambda: lag("oi", 1), lagged("oi", 1)), "close_was": (lambda: lag("close", 1), lagged("close", 1))}]


@register(
    "detect_liquidation_cascade",
    wide_sql(_CASCADE).replace("WITH ", "WITH RECURSIVE ", 1)
    + f", b AS (SELECT *, {_BAR}, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, hit ORDER BY ts) AS g FROM wide), spans AS (SELECT symbol, bar, max(bar) OVER (PARTITION BY symbol, g) AS leave, oi_was, close_was FROM b WHERE hit), "
    + cooled_sql(4)
    + f" SELECT k.symbol, k.bar, s.leave, {s6('sum(b.quote_volume)')} AS total, {s6('(any_value(s.oi_was) - max(CASE WHEN b.bar = s.leave THEN b.oi END)) / any_value(s.oi_was)')} AS oi_reduction, {s6('(any_value(s.close_was) - min(b.low)) / any_value(s.close_was)')} AS drawdown FROM kept k JOIN spans s USING (symbol, bar) JOIN b ON b.symbol = k.symbol AND b.bar BETWEEN k.bar AND s.leave GROUP BY 1, 2, 3",
)
def detect_liquidation_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Runs of forced selling; what is left of a run from each of its bars on is known before the cool-down picks bars."""
    df = runs(numbered(wide(spark, d, _CASCADE)), F.col("hit"), ["symbol"]).where("hit")
    left = Window.partitionBy("symbol", "run_id").orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    spans = df.select("symbol", "bar", F.max("bar").over(left).alias("leave"), F.sum("quote_volume").over(left).alias("total"), F.min("low").over(left).alias("low"), F.last("oi").over(left).alias("oi_end"), "oi_was", "close_was")
    kept = cool_down(spans, ["symbol"], "bar", "leave", 4)
    return kept.select("symbol", "bar", "leave", r6(F.col("total")).alias("total"), r6((F.col("oi_was") - F.col("oi_end")) / F.col("oi_was")).alias("oi_reduction"), r6((F.col("close_was") - F.col("low")) / F.col("close_was")).alias("drawdown"))


# --- venues, flow, compression ------------------------------------------------------------------------

_DISLOC = [{"b_mid": (lambda: OrderStat("quantile", "basis", 48, 12, 0.5), roll("median", "basis", 48, 12)), "b_sd": (lambda: rolling(F.col("basis"), F.stddev_samp, 48, 12), roll("stddev_samp", "basis", 48, 12))}, {"b_z": (lambda: F.round(ratio(F.col("basis") - F.col("b_mid"), F.col("b_sd")), 9), "round((basis - b_mid) / nullif(b_sd, 0), 9)")}]
spaced("detect_basis_dislocation", _DISLOC, {"BASIS_DISLOC": (lambda: F.abs("b_z") > 2, "abs(b_z) > 2")}, 13)
_AHEAD = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {} FOLLOWING)"
_DESYNC = [
    {"apart": (lambda: F.round(F.abs("basis_z"), 9), "round(abs(basis_z), 9)")},
    {"stays": (lambda: F.coalesce(F.min("apart").over(P.W().rowsBetween(1, 2)), F.lit(9.0)) > 0.2, f"coalesce(min(apart) {_AHEAD.format(2)}, 9.0) > 0.2")},
]
spaced("detect_cross_venue_desync", _DESYNC, {"CROSS_VENUE_DESYNC": (lambda: (F.col("apart") >= 1.5) & F.col("stays"), "apart >= 1.5 AND stays")}, 6)
_FLOW = [
    {"flow": (lambda: F.round(ratio(2 * F.col("buy_volume") - F.col("volume"), F.col("volume")), 9), "round((2 * buy_volume - volume) / nullif(volume, 0), 9)"), "peak": (lambda: F.max("high").over(P.W().rowsBetween(1, 3)), f"max(high) {_AHEAD.format(3)}"), "floor_": (lambda: F.min("low").over(P.W().rowsBetween(1, 3)), f"min(low) {_AHEAD.format(3)}")},
    {"up": (lambda: OrderStat("quantile", "flow", 48, 24, 0.9), roll("quantile_cont(?, 0.9)", "flow", 48, 24)), "down": (lambda: OrderStat("quantile", "flow", 48, 24, 0.1), roll("quantile_cont(?, 0.1)", "flow", 48, 24))},
]
spaced(
    "detect_forced_flow_exhaustion",
    _FLOW,
    {"FORCED_BUYING": (lambda: (F.col("flow") >= F.round("up", 9)) & (F.col("peak") <= F.col("high")), "flow >= round(up, 9) AND peak <= high"), "FORCED_SELLING": (lambda: (F.col("flow") <= F.round("down", 9)) & (F.col("floor_") >= F.col("low")), "flow <= round(down, 9) AND floor_ >= low")},
    6,
)
_TIGHT = [{"tight": (lambda: _true(F.col("ratio_now") <= 0.8), "coalesce(ratio_now <= 0.8, FALSE)")}, {"starts": (lambda: F.col("tight") & ~_true(lag("tight", 1)), f"tight AND NOT coalesce({lagged('tight', 1)}, FALSE)"), "top": (lambda: F.max("close").over(P.W().rowsBetween(1, 24)), f"max(close) {_AHEAD.format(24)}"), "later": (lambda: F.lead("close", 12).over(P.W()), "lead(close, 12) OVER (PARTITION BY symbol ORDER BY ts)")}]


@register(
    "compression_episode",
    f"{wide_sql(_TIGHT)}, g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, tight ORDER BY ts) AS g FROM wide), r AS (SELECT *, count(*) OVER (PARTITION BY symbol, tight, g) AS n FROM g) "
    f"SELECT symbol, ts, least(n, 24) AS duration, n <= 24 AS expanded, {s6('top / nullif(close, 0) - 1')} AS mfe, {s6('later / nullif(close, 0) - 1')} AS ret_12 FROM r WHERE starts",
)
def compression_episode(spark: SparkSession, d: str) -> DataFrame:
    df = runs(wide(spark, d, _TIGHT), F.col("tight"), ["symbol"]).where("starts")
    return df.select("symbol", "ts", F.least(F.col("run_length"), F.lit(24)).alias("duration"), (F.col("run_length") <= 24).alias("expanded"), r6(ratio(F.col("top"), F.col("close")) - 1).alias("mfe"), r6(ratio(F.col("later"), F.col("close")) - 1).alias("ret_12"))


_METRICS = [{"mean_rv": (lambda: F.avg("rv").over(P.W().rowsBetween(1, 12)), f"avg(rv) {_AHEAD.format(12)}"), "max_move": (lambda: F.max("abs_ret").over(P.W().rowsBetween(1, 12)), f"max(abs_ret) {_AHEAD.format(12)}"), "p90_range": (lambda: F.percentile("bar_range", F.lit(0.9)).over(P.W().rowsBetween(1, 12)), f"quantile_cont(bar_range, 0.9) {_AHEAD.format(12)}")}]
register("window_metrics", f"{wide_sql(_METRICS)} SELECT symbol, ts, {s6('mean_rv')} AS mean_rv, {s6('max_move')} AS max_move, {s6('p90_range')} AS p90_range FROM wide WHERE spread_z > 2")(
    lambda spark, d: wide(spark, d, _METRICS).where("spread_z > 2").select("symbol", "ts", *[r6(F.col(c)).alias(c) for c in ("mean_rv", "max_move", "p90_range")])
)


@register(
    "event_rows",
    f"WITH RECURSIVE {_HITS_SQL}, {_KEPT_SQL}, e AS (SELECT event_type, symbol, h.ts, h.bar, row_number() OVER (PARTITION BY event_type, symbol ORDER BY h.bar) - 1 AS n FROM hits h JOIN kept USING (event_type, symbol, bar)), g AS (SELECT symbol, max(ts) AS z FROM cleaned GROUP BY 1) "
    "SELECT printf('%s_%s_%08d_%03d', event_type, symbol, bar, n) AS event_id, event_type, symbol, e.ts AS enter_ts, least(e.ts + INTERVAL 12 HOUR, z) AS exit_ts FROM e JOIN g USING (symbol)",
)
def event_rows(spark: SparkSession, d: str) -> DataFrame:
    kept = detect(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("event_type", "symbol").orderBy("bar")) - 1)
    ends = P.bars(spark, d).groupBy("symbol").agg(F.max("ts").alias("z"))
    named = kept.join(F.broadcast(ends), "symbol")
    return named.select(F.format_string("%s_%s_%08d_%03d", "event_type", "symbol", "bar", "n").alias("event_id"), "event_type", "symbol", F.col("ts").alias("enter_ts"), F.least(F.col("ts") + F.expr("interval 12 hours"), F.col("z")).alias("exit_ts"))


# --- registry --------------------------------------------------------------------------------------------

_REG = """reg AS (SELECT * FROM (SELECT upper(trim(event_type)) AS event_type, 'S' || (user_id % 5) AS symbol, CAST(event_id AS VARCHAR) AS event_id, ts AS enter_ts, ts + INTERVAL 1 MINUTE AS detected_ts,
 greatest(ts, ts + to_minutes(CAST(json_extract(props, '$.k') AS INTEGER) - 20)) AS exit_ts, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, row_number() OVER (PARTITION BY event_type, ts, user_id % 5 ORDER BY event_id) AS n FROM events) WHERE n = 1)"""


def normalized(spark: SparkSession, d: str) -> DataFrame:
    """Events in the registry's form: upper-case types, an exit not before the entry, features as a map, one row per type, time and symbol."""
    k = F.from_json("props", "k double")["k"]
    e = keep_one(P.table(spark, d, "events").withColumn("symbol", F.concat(F.lit("S"), F.col("user_id") % 5)), ["event_type", "ts", "symbol"], F.col("event_id"))
    late = F.col("ts") + F.make_dt_interval(mins=k.cast("int") - 20)
    return e.select(F.upper(F.trim("event_type")).alias("event_type"), "symbol", F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("enter_ts"), (F.col("ts") + F.expr("interval 1 minute")).alias("detected_ts"), F.greatest(F.col("ts"), F.coalesce(late, F.col("ts"))).alias("exit_ts"), F.create_map(F.lit("k"), k).alias("features"))


register("reg_normalize", f"WITH {_REG} SELECT event_type, symbol, event_id, enter_ts, detected_ts, exit_ts, k FROM reg")(lambda spark, d: normalized(spark, d).select("event_type", "symbol", "event_id", "enter_ts", "detected_ts", "exit_ts", F.col("features")["k"].alias("k")))
register("reg_collect", f"WITH {_REG} SELECT event_type, symbol, enter_ts FROM reg UNION ALL SELECT 'ORDER', 'S' || (o_custkey % 5), o_orderdate FROM orders")(
    lambda spark, d: normalized(spark, d).select("event_type", "symbol", "enter_ts").unionByName(P.table(spark, d, "orders").select(F.lit("ORDER").alias("event_type"), F.concat(F.lit("S"), F.col("o_custkey") % 5).alias("symbol"), F.col("o_orderdate").alias("enter_ts")))
)
_GRID = "grid AS (SELECT symbol, unnest(generate_series(date_trunc('hour', min(enter_ts)), max(enter_ts), INTERVAL 1 HOUR)) AS ts FROM reg GROUP BY symbol)"


@register(
    "reg_flags",
    f"WITH {_REG}, {_GRID}, e AS (SELECT * FROM reg WHERE event_type = 'ERROR'), snap AS (SELECT e.symbol, (SELECT min(g.ts) FROM grid g WHERE g.symbol = e.symbol AND g.ts >= e.enter_ts) AS a, (SELECT min(g.ts) FROM grid g WHERE g.symbol = e.symbol AND g.ts > e.detected_ts) AS t, e.exit_ts FROM e) "
    "SELECT g.symbol, g.ts, EXISTS (SELECT 1 FROM snap s WHERE s.symbol = g.symbol AND s.a = g.ts) AS impulse, EXISTS (SELECT 1 FROM snap s WHERE s.symbol = g.symbol AND g.ts BETWEEN s.a AND greatest(s.exit_ts, s.a)) AS active, EXISTS (SELECT 1 FROM snap s WHERE s.symbol = g.symbol AND s.t = g.ts) AS tradable FROM grid g",
)
def reg_flags(spark: SparkSession, d: str) -> DataFrame:
    """Per bar: an event begins here, one is active, one may first be traded here (strictly after its detection)."""
    reg = normalized(spark, d)
    ends = reg.groupBy("symbol").agg(F.date_trunc("HOUR", F.min("enter_ts")).cast("timestamp_ntz").alias("a"), F.max("enter_ts").alias("z"))
    grid = ends.select("symbol", F.explode(F.sequence("a", "z", F.expr("interval 1 hour"))).alias("ts"))
    bars = grid.withColumn("bar_ts", F.col("ts"))
    own = reg.where("event_type = 'ERROR'")
    begun = asof_join(own.withColumn("ts", F.col("enter_ts")), bars, ["symbol"], forward=True).where("bar_ts is not null").select("symbol", F.col("bar_ts").alias("enter_ts"), F.greatest("exit_ts", "bar_ts").alias("exit_ts"))
    told = asof_join(own.withColumn("ts", F.col("detected_ts")), bars, ["symbol"], forward=True, strict=True).select("symbol", F.col("bar_ts").alias("ts")).distinct().withColumn("tradable", F.lit(True))
    first = begun.select("symbol", F.col("enter_ts").alias("ts")).distinct().withColumn("impulse", F.lit(True))
    flags = active_on_grid(grid, begun, ["symbol"]).join(first, ["symbol", "ts"], "left").join(told, ["symbol", "ts"], "left")
    return flags.select("symbol", "ts", F.coalesce("impulse", F.lit(False)).alias("impulse"), "active", F.coalesce("tradable", F.lit(False)).alias("tradable"))


@register("reg_feature_frame", f"WITH {_REG}, l AS (SELECT * FROM reg WHERE event_type IN ('ERROR', 'SIGNUP') QUALIFY row_number() OVER (PARTITION BY symbol, enter_ts ORDER BY event_type DESC, event_id DESC) = 1) SELECT symbol, enter_ts AS ts, CASE WHEN event_type = 'ERROR' THEN k END AS error_k, CASE WHEN event_type = 'SIGNUP' THEN k END AS signup_k FROM l")
def reg_feature_frame(spark: SparkSession, d: str) -> DataFrame:
    return feature_frame(normalized(spark, d).where("event_type in ('ERROR', 'SIGNUP')"))


def feature_frame(registry: DataFrame, most: int = 1_000) -> DataFrame:
    """One row a symbol and time with the features of its last event (by type, then id), named by type and feature.

    The names come from the table; more than `most` of them raise.
    """
    last = keep_one(registry, ["symbol", "enter_ts"], F.col("event_type").desc(), F.col("event_id").desc())
    long_ = last.select("symbol", F.col("enter_ts").alias("ts"), F.lower("event_type").alias("type"), F.explode_outer("features").alias("key", "v")).withColumn("name", F.concat_ws("_", "type", "key"))
    names = [r["name"] for r in registry.select(F.lower("event_type").alias("type"), F.explode(F.map_keys("features")).alias("key")).select(F.concat_ws("_", "type", "key").alias("name")).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} feature names")
    return long_.groupBy("symbol", "ts").pivot("name", sorted(names)).agg(F.max("v")) if names else last.select("symbol", F.col("enter_ts").alias("ts"))


register("reg_contract", f"WITH {_REG} SELECT event_type, count(*) AS n, count(*) FILTER (WHERE detected_ts < enter_ts) AS early, count(*) FILTER (WHERE exit_ts < enter_ts) AS reversed, count(*) FILTER (WHERE minute(enter_ts) % 5 <> 0 OR second(enter_ts) <> 0) AS off_grid FROM reg GROUP BY 1")(
    lambda spark, d: normalized(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("detected_ts") < F.col("enter_ts")).alias("early"), F.count_if(F.col("exit_ts") < F.col("enter_ts")).alias("reversed"), F.count_if((F.minute("enter_ts") % 5 != 0) | (F.second("enter_ts") != 0)).alias("off_grid"))
)
