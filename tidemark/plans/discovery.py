"""Pairs of series, matched controls by cascade, hazard shapes, delays, actions, costs from quotes and the last of the streams."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import ordered, ratio
from ..functions.tails import normal_cdf, normal_quantile, student_two_sided
from ..operators.align import asof_join
from ..operators.greedy import space_out
from ..operators.pooling import pool
from ..streaming.streams import event_stream, stream_cooldown, stream_quotes
from . import panel as P
from .more_features import FEAT, wide, wide_sql
from .queries import _drained, oracle_sql, queries, r6, register, s6  # noqa: F401
from .statistics import hazards
from .study import _TAU_SQL, _taus, ahead, candidates, feat, lead, unit, unit_sql

W = ordered

# --- pairs of series -----------------------------------------------------------------------------------

#: The pairs of symbols to compare.
PAIRS = [("click", "view"), ("error", "purchase"), ("signup", "click")]


def paired(bars: DataFrame, pairs: list[tuple[str, str]] = PAIRS) -> DataFrame:
    """(pair, ts, bar, r1, r2): log returns of both symbols over the times that have both prices, numbered from 1."""
    sides = F.array(*[F.struct(F.lit(f"{a}/{b}").alias("pair"), F.lit(s).alias("of"), F.lit(side).alias("side")) for a, b in pairs for s, side in ((a, 1), (b, 2))])
    long = bars.select("symbol", "ts", "close", F.explode(sides).alias("p")).where("symbol = p.of").select("p.pair", "p.side", "ts", "close")
    both = long.groupBy("pair", "ts").agg(*[F.max(F.when(F.col("side") == s, F.col("close"))).alias(f"c{s}") for s in (1, 2)]).where("c1 is not null and c2 is not null")
    line = Window.partitionBy("pair").orderBy("ts")
    back = both.withColumns({f"r{s}": F.log(F.col(f"c{s}") / F.lag(f"c{s}").over(line)) for s in (1, 2)}).where("r1 is not null and r2 is not null")
    return back.select("pair", "ts", F.row_number().over(line).cast("long").alias("bar"), "r1", "r2")


_PAIRED = f"""{P.CLEANED_SQL}, names AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in PAIRS)}) v(a, b)),
 common AS (SELECT n.a || '/' || n.b AS pair, x.ts, x.close AS c1, y.close AS c2 FROM names n JOIN cleaned x ON x.symbol = n.a JOIN cleaned y ON y.symbol = n.b AND y.ts = x.ts WHERE x.close IS NOT NULL AND y.close IS NOT NULL),
 steps AS (SELECT pair, ts, ln(c1 / lag(c1) OVER w) AS r1, ln(c2 / lag(c2) OVER w) AS r2 FROM common WINDOW w AS (PARTITION BY pair ORDER BY ts)),
 paired AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) AS bar FROM steps WHERE r1 IS NOT NULL AND r2 IS NOT NULL)"""


def mean_share(value: str, by: str) -> Column:
    """The value's rank as a share of its group, equal values at their mean rank."""
    same = F.count("*").over(Window.partitionBy(by, value))
    return (F.rank().over(Window.partitionBy(by).orderBy(value)) + (same - 1) / 2) / F.count("*").over(Window.partitionBy(by))


@register("detect_copula_pairs")
def detect_copula_pairs(spark: SparkSession, d: str, low: float = 0.05, high: float = 0.95, cooldown: int = 12, least: int = 288) -> DataFrame:
    """Bars where one return is extreme given the other, by a Gaussian copula over the pair's whole series.

    Pairs of fewer than `least` common prices give none. After an event `cooldown` bars are skipped.
    """
    return copula_events(paired(P.cleaned(spark, d)), low, high, cooldown, least)


def copula_events(series: DataFrame, low: float, high: float, cooldown: int, least: int) -> DataFrame:
    shares = series.withColumns({"u1": mean_share("r1", "pair"), "u2": mean_share("r2", "pair")})
    z = shares.select("pair", "ts", "bar", normal_quantile("u1").alias("z1"), normal_quantile("u2").alias("z2"))
    fit = z.groupBy("pair").agg(F.corr("z1", "z2").alias("rho"), F.count("*").alias("n")).where(F.col("n") + 1 >= least)
    given = (F.col("z1") - F.col("rho") * F.col("z2")) / F.sqrt(1 - F.col("rho") * F.col("rho"))
    index = z.join(fit, "pair").withColumn("mispricing", normal_cdf(given))
    kept = space_out(index.where((F.col("mispricing") < low) | (F.col("mispricing") > high)), ["pair"], "bar", cooldown + 1)
    return kept.select("pair", "ts", "bar", r6(F.col("mispricing")).alias("mispricing"), r6(F.abs(F.col("mispricing") - 0.5) * 2).alias("severity"))


register(
    "kendall_tau",
    f"""WITH {_PAIRED} SELECT a.pair, {s6('sum(sign(a.r1 - b.r1) * sign(a.r2 - b.r2)) / sqrt(sum(CASE WHEN a.r1 <> b.r1 THEN 1.0 ELSE 0 END) * sum(CASE WHEN a.r2 <> b.r2 THEN 1.0 ELSE 0 END))')} AS tau
 FROM paired a JOIN paired b ON a.pair = b.pair AND a.bar < b.bar GROUP BY 1""",
)(lambda spark, d: kendall_tau(paired(P.cleaned(spark, d)), "pair", "r1", "r2").select("pair", r6(F.col("tau")).alias("tau")))


def kendall_tau(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, tau): tau-b of two columns, exact and without pairs.

    Rows that disagree are the inversions of y in the order of x. They are counted bit by bit of y's dense rank: among rows
    that share the higher bits, each row with a 0 disagrees with the rows before it that have a 1. So n rows become
    n log n, each counted by a running sum.
    """
    ranks = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, *[F.dense_rank().over(Window.partitionBy(by).orderBy(c)).cast("long").alias(n) for c, n in ((x, "_x"), (y, "_y"))])
    pairs = F.sum(F.col("_c") * (F.col("_c") - 1) / 2)
    tied = lambda keys, name: ranks.groupBy(by, *keys).agg(F.count("*").alias("_c")).groupBy(by).agg(pairs.alias(name))
    width = F.length(F.conv(F.max("_y").over(Window.partitionBy(by)).cast("string"), 10, 2))
    bits = ranks.withColumn("_width", width).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_width") - 1))).withColumns({"_top": F.expr("shiftright(_y, _b + 1)"), "_bit": F.expr("shiftright(_y, _b) & 1")})
    before = F.sum("_bit").over(Window.partitionBy(by, "_b", "_top").orderBy("_x", "_y").rowsBetween(Window.unboundedPreceding, -1))
    discord = bits.withColumn("_before", before).groupBy(by).agg(F.sum(F.when(F.col("_bit") == 0, F.coalesce("_before", F.lit(0))).otherwise(0)).cast("double").alias("_d"))
    parts = tied([], "_n0").join(tied(["_x"], "_n1"), by).join(tied(["_y"], "_n2"), by).join(tied(["_x", "_y"], "_n3"), by).join(discord, by)
    agree = F.col("_n0") - F.col("_n1") - F.col("_n2") + F.col("_n3") - F.col("_d")
    return parts.select(by, ratio(agree - F.col("_d"), F.sqrt((F.col("_n0") - F.col("_n1")) * (F.col("_n0") - F.col("_n2")))).alias("tau"))


_PROFITS = {"trend": ("sign(round(trend, 9))", lambda: F.signum(F.round("trend", 9))), "revert": ("-sign(round(px_z, 9))", lambda: -F.signum(F.round("px_z", 9))), "carry": ("-sign(round(funding, 12))", lambda: -F.signum(F.round("funding", 12)))}
_NEXT = [{"next_ret": (lambda: ratio(lead("close", 1), F.col("close")) - 1, f"{ahead('close', 1)} / nullif(close, 0) - 1")}]


@register(
    "greedy_decorrelate",
    f"""{wide_sql(_NEXT).replace('WITH', 'WITH RECURSIVE', 1)}, pnl AS (
"""
    + " UNION ALL ".join(f"SELECT symbol || '_{n}' AS series, ts, {sql} * next_ret AS pnl FROM wide" for n, (sql, _) in _PROFITS.items())
    + """), c AS (SELECT a.series AS a, b.series AS b, CASE WHEN isfinite(corr(a.pnl, b.pnl)) THEN abs(corr(a.pnl, b.pnl)) END AS r FROM pnl a JOIN pnl b ON a.ts = b.ts GROUP BY 1, 2),
 o AS (SELECT a AS series, row_number() OVER (ORDER BY round(avg(CASE WHEN a <> b THEN r END), 9), a) AS k, coalesce(list(b) FILTER (WHERE a <> b AND r >= 0.3), []) AS near FROM c GROUP BY 1 HAVING count(CASE WHEN a <> b THEN r END) > 0),
 g AS (SELECT 1 AS k, [series] AS got FROM o WHERE k = 1 UNION ALL SELECT o.k, CASE WHEN len(got) < 8 AND NOT list_has_any(near, got) THEN list_append(got, series) ELSE got END FROM g JOIN o ON o.k = g.k + 1)
 SELECT unnest(got) AS series, unnest(range(1, len(got) + 1)) AS place FROM g WHERE k = (SELECT max(k) FROM g)""",
)
def greedy_decorrelate(spark: SparkSession, d: str, most_corr: float = 0.3, most: int = 8) -> DataFrame:
    """Profit series taken in the order of their mean correlation, each if none taken before correlates with it by `most_corr` or more.
    A series that has no correlation with any other (too few common values) is left out.

    All correlations are one aggregate over the times; the fold is over the series (the strategies), not over their rows.
    """
    made = F.array(*[F.struct(F.concat("symbol", F.lit(f"_{n}")).alias("series"), (c() * F.col("next_ret")).alias("pnl")) for n, (_, c) in _PROFITS.items()])
    long = wide(spark, d, _NEXT).select("ts", F.explode(made).alias("x")).select("ts", "x.*")
    names = sorted(r[0] for r in long.select("series").distinct().collect())  # one name a strategy
    table = long.groupBy("ts").pivot("series", names).agg(F.first("pnl"))
    links = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.nanvl(F.abs(F.corr(F.col(f"`{a}`"), F.col(f"`{b}`"))), F.lit(None).cast("double")).alias("r")) for a, b in combinations(names, 2)]
    one = table.agg(F.array(*links).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    both = one.select(F.explode(F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))).alias("x")).select("x.*")
    near = both.groupBy("a").agg(F.round(F.avg("r"), 9).alias("mean"), F.collect_list(F.when(F.col("r") >= most_corr, F.col("b"))).alias("near")).where("mean is not null")
    order = near.agg(F.sort_array(F.collect_list(F.struct("mean", F.col("a").alias("series"), "near"))).alias("all"))
    taken = F.aggregate("all", F.array().cast("array<string>"), lambda got, s: F.when((F.size(got) < most) & ~F.arrays_overlap(got, s["near"]), F.array_append(got, s["series"])).otherwise(got))
    return order.select(F.posexplode(taken).alias("place", "series")).select("series", (F.col("place") + 1).cast("long").alias("place"))


# --- controls --------------------------------------------------------------------------------------------

_LOOK = 6
_BLOCK = [{"blocked": (lambda: F.coalesce(F.max(F.when(F.col("spread_z") > 1, 1)).over(P.W().rowsBetween(-_LOOK, 0)), F.lit(0)), f"coalesce(max(CASE WHEN spread_z > 1 THEN 1 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {_LOOK} PRECEDING AND CURRENT ROW), 0)"),
           "after": (lambda: lead("symbol", _LOOK), ahead("symbol", _LOOK))}]
_KEYS = ["symbol || '|1|' || vol_q || '|' || slot", "symbol || '|2|' || vol_q", "symbol || '|3|' || slot", "symbol || '|4'"]


@register(
    "control_match_exact",
    f"""{wide_sql(_BLOCK)}, q AS (SELECT *, CAST(CASE WHEN rv_z <= -0.5 THEN 0 WHEN rv_z <= 0.5 THEN 1 WHEN rv_z IS NOT NULL THEN 2 END AS VARCHAR) AS vol_q, CAST(hour(ts) // 3 AS VARCHAR) AS slot, CAST(epoch_us(ts) AS VARCHAR) AS us FROM wide),
 lv AS (SELECT q.*, l, CASE l {' '.join(f'WHEN {i} THEN {k}' for i, k in enumerate(_KEYS, 1))} END AS key FROM q, (SELECT unnest(range(1, 5)) AS l)),
 pool AS (SELECT key, ts AS control_ts, bar_range AS control, row_number() OVER (PARTITION BY key ORDER BY md5(symbol || '|' || us), ts) - 1 AS k, count(*) OVER (PARTITION BY key) AS n FROM lv WHERE blocked = 0 AND after IS NOT NULL AND vol_q IS NOT NULL),
 ev AS (SELECT e.symbol, e.ts, e.us, e.bar_range, e.l, e.key, p.n FROM lv e JOIN (SELECT DISTINCT key, n FROM pool) p USING (key) WHERE e.spread_z > 1 QUALIFY row_number() OVER (PARTITION BY e.symbol, e.ts ORDER BY e.l) = 1),
 pick AS (SELECT *, CAST(floor({unit_sql('symbol', 'us', 's')} * n) AS BIGINT) AS k FROM ev, (SELECT unnest(range(1, 4)) AS s))
 SELECT c.symbol, c.ts, CAST(c.s AS INTEGER) AS sample, CAST(c.l AS INTEGER) AS level, p.control_ts, {s6('c.bar_range - p.control')} AS delta FROM pick c JOIN pool p ON p.key = c.key AND p.k = c.k""",
)
def control_match_exact(spark: SparkSession, d: str, samples: int = 3) -> DataFrame:
    """`samples` controls an event, with replacement: of its volatility class and time of day, else of the class, else of the time,
    else of its symbol. Controls lie outside the bars that an event looks ahead over. Pools are numbered in hash order and
    the event's hash picks numbers, so joins are by equality; which level an event takes comes from the pools' sizes."""
    vol = F.when(F.col("rv_z") <= -0.5, "0").when(F.col("rv_z") <= 0.5, "1").when(F.col("rv_z").isNotNull(), "2")
    q = wide(spark, d, _BLOCK).withColumns({"vol_q": vol, "slot": F.floor(F.hour("ts") / 3).cast("string"), "us": F.unix_micros(F.col("ts").cast("timestamp")).cast("string")})
    keys = F.array(*[F.struct(F.lit(i).alias("level"), F.expr(k).alias("key")) for i, k in enumerate(_KEYS, 1)])
    levels = q.select("symbol", "ts", "us", "bar_range", "spread_z", "blocked", "after", "vol_q", F.explode(keys).alias("x")).select("*", "x.level", "x.key").where("key is not null")
    order = Window.partitionBy("key").orderBy(F.md5(F.concat_ws("|", "symbol", "us").cast("binary")), "ts")
    free = levels.where("blocked = 0 and after is not null and vol_q is not null").select("key", F.col("ts").alias("control_ts"), F.col("bar_range").alias("control"), (F.row_number().over(order) - 1).cast("long").alias("k"))
    sizes = free.groupBy("key").agg(F.count("*").alias("n"))
    first = levels.where("spread_z > 1").join(sizes, "key").groupBy("symbol", "ts", "us", "bar_range").agg(F.min_by(F.struct("level", "key", "n"), "level").alias("p")).select("symbol", "ts", "us", "bar_range", "p.*")
    picked = first.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("k", F.floor(unit(F.col("symbol"), F.col("us"), F.col("sample").cast("string")) * F.col("n")))
    return picked.join(free, ["key", "k"]).select("symbol", "ts", "sample", "level", "control_ts", r6(F.col("bar_range") - F.col("control")).alias("delta"))


# --- hazard shapes, delays, actions ------------------------------------------------------------------------


def _curve_sql(name: str, hit: str) -> str:
    age = f"first_value(CASE WHEN {hit} THEN bar END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) - bar"
    return f"h_{name} AS (SELECT symbol, {age} AS age FROM b), {name} AS (SELECT h.symbol, a.age, avg(CASE WHEN h.age = a.age THEN 1.0 ELSE 0.0 END) AS hazard FROM h_{name} h JOIN (SELECT unnest(range(1, 25)) AS age) a ON h.age IS NULL OR h.age >= a.age GROUP BY 1, 2)"


_TWO = f"WITH {P.CLEANED_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar FROM cleaned), {_curve_sql('liq', 'volume < 4')}, {_curve_sql('vol', 'close > 300')}"


def two_hazards(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, age, liq, vol): the hazards of a thin bar and of a high price."""
    bars = P.cleaned(spark, d)
    rate = lambda hit, name: hazards(bars, hit).select("symbol", "age", (F.col("n_hits") / F.col("at_risk")).alias(name))
    return rate(F.col("volume") < 4, "liq").join(rate(F.col("close") > 300, "vol"), ["symbol", "age"], "full")


register(
    "hazard_crossover",
    f"""{_TWO}, j AS (SELECT coalesce(l.symbol, v.symbol) AS symbol, coalesce(l.age, v.age) AS age, l.hazard - v.hazard AS delta FROM liq l FULL JOIN vol v ON l.symbol = v.symbol AND l.age = v.age),
 w AS (SELECT symbol, age, avg(delta) OVER o AS mean, count(delta) OVER o AS n FROM j WINDOW o AS (PARTITION BY symbol ORDER BY age ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
 SELECT symbol, CAST(min(CASE WHEN age >= 2 AND n = 3 AND round(mean, 12) > 0 THEN age END) AS INTEGER) AS crossover FROM w GROUP BY 1""",
)(lambda spark, d: crossover(two_hazards(spark, d)))


def crossover(curves: DataFrame, start: int = 2, confirm: int = 3) -> DataFrame:
    """The first age from `start` on where liquidity's hazard is above volatility's in the mean of `confirm` ages."""
    later = Window.partitionBy("symbol").orderBy("age").rowsBetween(0, confirm - 1)
    delta = F.col("liq") - F.col("vol")
    w = curves.withColumns({"mean": F.avg(delta).over(later), "n": F.count(delta).over(later)})
    return w.groupBy("symbol").agg(F.min(F.when((F.col("age") >= start) & (F.col("n") == confirm) & (F.round("mean", 12) > 0), F.col("age"))).alias("crossover"))


_SHAPE = {n: f"arg_max(age, struct_pack(a := round({n}.hazard, 12), b := -age)) AS peak, avg(CASE WHEN age <= 8 THEN hazard END) AS front, avg(CASE WHEN age >= 17 THEN hazard END) AS late" for n in ("liq", "vol")}
register(
    "hazard_shape",
    f"""{_TWO}, sl AS (SELECT symbol, {_SHAPE['liq']} FROM liq GROUP BY 1), sv AS (SELECT symbol, {_SHAPE['vol']} FROM vol GROUP BY 1)
 SELECT symbol, coalesce(sv.peak <= 8 OR sv.front > sv.late, FALSE) AS vol_front_loaded, coalesce(sl.peak >= 9 OR sl.late > sl.front, FALSE) AS liq_delayed,
 coalesce(sv.peak <= 8 OR sv.front > sv.late, FALSE) AND coalesce(sl.peak >= 9 OR sl.late > sl.front, FALSE) AS shape_consistent FROM sl JOIN sv USING (symbol)""",
)(lambda spark, d: hazard_shape(two_hazards(spark, d)))


def hazard_shape(curves: DataFrame, front: int = 8, late: int = 17) -> DataFrame:
    """Whether volatility's hazard lies in front, liquidity's comes late, and both; the earliest of equal peaks counts."""
    parts = lambda c: [F.max_by("age", F.struct(F.round(c, 12), -F.col("age"))).alias(f"{c}_peak"), F.avg(F.when(F.col("age") <= front, F.col(c))).alias(f"{c}_front"), F.avg(F.when(F.col("age") >= late, F.col(c))).alias(f"{c}_late")]
    s = curves.groupBy("symbol").agg(*parts("liq"), *parts("vol"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    ahead_, behind = yes((F.col("vol_peak") <= front) | (F.col("vol_front") > F.col("vol_late"))), yes((F.col("liq_peak") > front) | (F.col("liq_late") > F.col("liq_front")))
    return s.select("symbol", ahead_.alias("vol_front_loaded"), behind.alias("liq_delayed"), (ahead_ & behind).alias("shape_consistent"))


_DELAYS = (0, 1, 2, 4, 8)
_DELAYED = [{f"d{k}": (lambda k=k: ratio(lead("close", k + 4), lead("close", k + 1)) - 1, f"{ahead('close', k + 4)} / nullif({ahead('close', k + 1)}, 0) - 1") for k in _DELAYS}]


@register(
    "delay_robustness",
    f"""{wide_sql(_DELAYED)}, m AS (SELECT symbol, unnest([{', '.join(f'avg(d{k})' for k in _DELAYS)}]) AS e FROM wide WHERE spread_z > 1 GROUP BY symbol),
 s AS (SELECT symbol, avg(CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END) AS positive, stddev_pop(e) AS dispersion, avg(e) AS m FROM m WHERE e IS NOT NULL GROUP BY symbol),
 f AS (SELECT *, 0.7 * positive + 0.3 * greatest(0.0, 1 - dispersion / greatest(abs(m), 1e-9)) AS score FROM s)
 SELECT symbol, {s6('positive')} AS positive, {s6('dispersion')} AS dispersion, {s6('score')} AS score, positive >= 0.6 AND score >= 0.6 AS robust FROM f""",
)
def delay_robustness(spark: SparkSession, d: str, least_positive: float = 0.6, least_score: float = 0.6) -> DataFrame:
    """How an event's mean return holds when it is entered some bars later: 0.7 of the share of positive delays and 0.3 of their evenness."""
    means = wide(spark, d, _DELAYED).where("spread_z > 1").groupBy("symbol").agg(F.array(*[F.avg(f"d{k}") for k in _DELAYS]).alias("e")).select("symbol", F.explode("e").alias("e")).where("e is not null")
    s = means.groupBy("symbol").agg(F.avg(F.when(F.col("e") > 0, 1.0).otherwise(0.0)).alias("positive"), F.stddev_pop("e").alias("dispersion"), F.avg("e").alias("m"))
    score = 0.7 * F.col("positive") + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("dispersion") / F.greatest(F.abs("m"), F.lit(1e-9)))
    s = s.withColumn("score", score)
    return s.select("symbol", *[r6(F.col(c)).alias(c) for c in ("positive", "dispersion", "score")], ((F.col("positive") >= least_positive) & (F.col("score") >= least_score)).alias("robust"))


_H = 12
_SOON = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {_H} FOLLOWING)"
_PROXY = [{"t_adverse": (lambda: F.timestamp_diff("HOUR", F.col("ts"), F.min(F.when(F.col("spread_z") > 1, F.col("ts"))).over(P.W().rowsBetween(1, _H))), f"date_diff('hour', ts, min(CASE WHEN spread_z > 1 THEN ts END) {_SOON})"),
           "t_relaxed": (lambda: F.timestamp_diff("HOUR", F.col("ts"), F.min(F.when(F.col("rv_z") < 0, F.col("ts"))).over(P.W().rowsBetween(1, _H))), f"date_diff('hour', ts, min(CASE WHEN rv_z < 0 THEN ts END) {_SOON})")}]
#: Actions: (share of the exposure taken away, the bars from the event on in which harm is avoided; null: all).
_ACTIONS = {"no_action": ("0.0", "-1"), "gate": ("1.0", None), "throttle_half": ("0.5", None), "delay_4": (f"least(1.0, 4.0 / {_H})", "4"), "delay_8": (f"least(1.0, 8.0 / {_H})", "8"), "reenable_at_half_life": (f"least(1.0, coalesce(t_relaxed, 1000000) / {_H}.0)", "coalesce(t_relaxed, 1000000)")}


def _saved(name: str) -> str:
    """The harm an action avoids: its share of all harm, or all harm that comes within its bars."""
    share, bars = _ACTIONS[name]
    return f"{share} * adverse" if bars is None else f"CASE WHEN coalesce(t_adverse, 1000000000) <= {bars} THEN adverse ELSE 0.0 END"


_EFFECTS = "SELECT *, 0.5 * CASE WHEN t_adverse IS NOT NULL THEN 1.0 ELSE 0.0 END + 0.5 * greatest(coalesce(range_24, 0.0), 0.0) AS adverse, CASE WHEN t_relaxed IS NOT NULL THEN 1.0 ELSE 0.0 END AS chance"


@register(
    "interaction_action_proxy",
    f"{wide_sql(_PROXY)}, e AS ({_EFFECTS} FROM wide WHERE spread_z > 1), x AS ("
    + " UNION ALL ".join(f"SELECT symbol, '{n}' AS action, {_saved(n)} AS saved, {share} * chance AS lost FROM e" for n, (share, _) in _ACTIONS.items())
    + f") SELECT symbol, action, {s6('avg(saved)')} AS risk_reduction, {s6('avg(lost)')} AS opportunity_cost, {s6('avg(saved) - greatest(0.0, avg(lost))')} AS net_benefit FROM x GROUP BY 1, 2",
)
def interaction_action_proxy(spark: SparkSession, d: str) -> DataFrame:
    """What gating, throttling, delaying or waiting for calm would save in harm and cost in chances, per symbol."""
    e = wide(spark, d, _PROXY).where("spread_z > 1")
    adverse = 0.5 * F.when(F.col("t_adverse").isNotNull(), 1.0).otherwise(0.0) + 0.5 * F.greatest(F.coalesce("range_24", F.lit(0.0)), F.lit(0.0))
    e = e.withColumns({"adverse": adverse, "chance": F.when(F.col("t_relaxed").isNotNull(), 1.0).otherwise(0.0)})
    never, wait = F.lit(1_000_000_000), F.coalesce("t_relaxed", F.lit(1_000_000))
    within = lambda bars: F.when(F.coalesce("t_adverse", never) <= bars, F.col("adverse")).otherwise(0.0)
    part = lambda bars: F.least(F.lit(1.0), bars / F.lit(float(_H)))
    made = {"no_action": (F.lit(0.0), F.lit(0.0)), "gate": (F.col("adverse"), F.lit(1.0)), "throttle_half": (0.5 * F.col("adverse"), F.lit(0.5))}
    made |= {f"delay_{k}": (within(F.lit(k)), part(F.lit(k))) for k in (4, 8)} | {"reenable_at_half_life": (within(wait), part(wait))}
    rows = F.array(*[F.struct(F.lit(n).alias("action"), saved.alias("saved"), (share * F.col("chance")).alias("lost")) for n, (saved, share) in made.items()])
    g = e.select("symbol", F.explode(rows).alias("x")).groupBy("symbol", "x.action").agg(F.avg("x.saved").alias("saved"), F.avg("x.lost").alias("lost"))
    return g.select("symbol", "action", r6(F.col("saved")).alias("risk_reduction"), r6(F.col("lost")).alias("opportunity_cost"), r6(F.col("saved") - F.greatest(F.lit(0.0), F.col("lost"))).alias("net_benefit"))


TERMS = ["intercept", "persistence", "is_bull", "is_high_vol", "is_second", "p_x_bull", "p_x_high_vol", "p_x_second"]


def lpm_rows(spark: SparkSession, d: str, first: str = "click", second: str = "purchase") -> DataFrame:
    """(period, y, persistence, is_bull, is_high_vol, is_second) of two symbols; the period is the week, whether the next bar rises is y."""
    w = wide(spark, d, _NEXT).where(F.col("symbol").isin(first, second)).where("next_ret is not null and spread_z is not null and trend is not null and rv_z is not null")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return w.select(F.date_trunc("WEEK", "ts").cast("date").cast("string").alias("period"), flag(F.col("next_ret") > 0).alias("y"), flag(F.col("spread_z") > 1).alias("persistence"), flag(F.round("trend", 9) > 0).alias("is_bull"), flag(F.round("rv_z", 9) > 0).alias("is_high_vol"), flag(F.col("symbol") == second).alias("is_second"))


@register("interaction_lpm")
def interaction_lpm(spark: SparkSession, d: str) -> DataFrame:
    return linear_probability(lpm_rows(spark, d))


def linear_probability(rows: DataFrame, least: int = 100, tiny: float = 1e-8) -> DataFrame:
    """(term, full_coef, periods, signs, status) of the interactions of a linear probability model, over all rows and by period.

    Spark sums the products of the terms per period (one row of 44 sums each); the small systems are solved from these, by
    least norm where terms depend on each other. A term passes when its sign is the same in all periods of at least `least` rows.
    """
    x = [F.lit(1.0), *map(F.col, TERMS[1:5]), *[F.col("persistence") * F.col(c) for c in TERMS[2:5]]]
    cells = [(i, j) for i in range(8) for j in range(i, 8)]
    sums = rows.groupBy("period").agg(F.count("*").alias("n"), F.array(*[F.sum(x[i] * x[j]) for i, j in cells]).alias("xx"), F.array(*[F.sum(c * F.col("y")) for c in x]).alias("xy"))

    def solve(periods: pd.DataFrame) -> pd.DataFrame:
        def fit(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
            gram = np.zeros((8, 8))
            for (i, j), v in zip(cells, xx, strict=True):
                gram[i, j] = gram[j, i] = v
            return (np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ xy)[5:]

        sign = lambda b: np.where(b > tiny, 1, np.where(b < -tiny, -1, 0))
        periods = periods.sort_values("period")
        whole = fit(np.sum(np.stack(periods["xx"]), axis=0), np.sum(np.stack(periods["xy"]), axis=0))
        used = [sign(fit(np.asarray(r.xx), np.asarray(r.xy))) for r in periods.itertuples() if r.n >= least]
        out = []
        for t, term in enumerate(TERMS[5:]):
            signs = [int(s[t]) for s in used]
            clear = {s for s in signs if s}
            status = "insufficient" if not clear else "pass" if len(clear) == 1 and int(sign(whole)[t]) in (0, *clear) else "fail_sign_flip"
            out.append((term, round(float(whole[t]), 6), len(signs), ",".join(map(str, signs)), status))
        return pd.DataFrame(out, columns=["term", "full_coef", "periods", "signs", "status"])

    return sums.groupBy(F.lit("all")).applyInPandas(solve, "term string, full_coef double, periods long, signs string, status string")


# --- smoothing, costs, pooled p-values ---------------------------------------------------------------------


@register(
    "tau_ema",
    f"""{FEAT.replace('WITH', 'WITH RECURSIVE', 1)}, t AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, CAST({_TAU_SQL} AS DOUBLE) AS tau FROM feat WHERE spread_z > 1),
 s AS (SELECT symbol, ts, k, tau AS smooth FROM t WHERE k = 1 UNION ALL SELECT t.symbol, t.ts, t.k, 0.2 * t.tau + 0.8 * s.smooth FROM s JOIN t ON t.symbol = s.symbol AND t.k = s.k + 1)
 SELECT symbol, ts, {s6('smooth')} AS tau_smooth FROM s""",
)
def tau_ema(spark: SparkSession, d: str, alpha: float = 0.2) -> DataFrame:
    """The decay times of a symbol's events, smoothed along them; the first is taken as it is."""
    f = feat(spark, d)
    at = f.where("spread_z > 1").select("symbol", "ts")
    taus = _taus(f).join(at, ["symbol", "ts"]).withColumn("k", F.row_number().over(W()).cast("long"))
    return ema(taus, "symbol", "k", "tau_days", alpha).select("symbol", "ts", r6(F.col("ema")).alias("tau_smooth"))


def ema(df: DataFrame, by: str, place: str, value: str, alpha: float) -> DataFrame:
    """s[1] = x[1], s[k] = alpha x[k] + (1 - alpha) s[k - 1] as column `ema`, for places 1, 2, ... within `by`.

    An affine scan in blocks: a running sum inside each, then what the block before leaves over. A block is so long that
    the weight falls by e^-300 in it: the running sum's scale stays within a double, and nothing older than the block
    before can be seen. So alpha of 0.001 takes blocks of 300,000 rows, 0.5 of 432, 0.9 of 130.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    if alpha == 1:
        return df.withColumn("ema", F.col(value))
    block = max(1, int(300 / -math.log1p(-alpha)))
    keep, k = F.lit(1 - alpha), F.col(place) - 1
    df = df.withColumns({"_block": F.floor(k / block), "_at": (k % block).cast("double")})
    inside = Window.partitionBy(by, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    share = F.when(k == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    df = df.withColumn("_own", F.sum(share * F.col(value) * F.pow(keep, -F.col("_at"))).over(inside) * F.pow(keep, F.col("_at")))
    ends = df.groupBy(by, "_block").agg(F.max_by("_own", "_at").alias("_carry")).withColumn("_block", F.col("_block") + 1)
    whole = F.col("_own") + F.coalesce("_carry", F.lit(0.0)) * F.pow(keep, F.col("_at") + 1)
    return df.join(ends, [by, "_block"], "left").withColumn("ema", whole).drop("_block", "_at", "_own", "_carry")


@register(
    "cost_tob_regime",
    f"""WITH {P.CLEANED_SQL}, tob AS (SELECT symbol, ts, (high - low) / close * 10000 AS spread_bps, quote_volume AS depth FROM cleaned WHERE high > low AND close > 0 AND quote_volume > 0),
 base AS (SELECT symbol, median(spread_bps) AS bs, median(depth) AS bd FROM tob GROUP BY 1), ev AS (SELECT event_type AS symbol, ts FROM events WHERE user_id % 10 = 0 AND ts IS NOT NULL),
 m AS (SELECT e.symbol, e.ts, CASE WHEN t.ts >= e.ts - INTERVAL 2 HOUR THEN t.spread_bps END AS s, CASE WHEN t.ts >= e.ts - INTERVAL 2 HOUR THEN t.depth END AS q FROM ev e ASOF LEFT JOIN tob t ON e.symbol = t.symbol AND e.ts >= t.ts),
 a AS (SELECT symbol, count(*) AS n, count(s) * 1.0 / count(*) AS coverage, quantile_cont(s, 0.9) AS s, quantile_cont(q, 0.1) AS q, greatest(1.0, sqrt(count(*) / greatest(1.0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 864e8) / 5.0)) AS turnover FROM m GROUP BY 1),
 c AS (SELECT a.*, coverage >= 0.8 AND s > 0 AND q > 0 AND bs IS NOT NULL AS ok, least(4.0, greatest(0.5, 0.7 * s / greatest(bs, 1e-6) + 0.3 * sqrt(greatest(bd, 1e-6) / greatest(q, 1e-6)))) AS mult FROM a LEFT JOIN base USING (symbol))
 SELECT symbol, n, {s6('coverage')} AS coverage, {s6('CASE WHEN ok THEN mult ELSE 1.0 END')} AS regime_mult, {s6('CASE WHEN ok THEN turnover ELSE 1.0 END')} AS turnover,
 {s6('4.0 + CASE WHEN ok THEN 2.0 * mult * turnover ELSE 2.0 END')} AS cost_bps, CASE WHEN ok THEN 'tob_regime' ELSE 'fallback' END AS source FROM c""",
)
def cost_tob_regime(spark: SparkSession, d: str) -> DataFrame:
    bars = P.cleaned(spark, d).where("high > low and close > 0 and quote_volume > 0")
    quotes = bars.select("symbol", "ts", ((F.col("high") - F.col("low")) / F.col("close") * 10000).alias("spread_bps"), F.col("quote_volume").alias("depth"))
    at = P.table(spark, d, "events").where("user_id % 10 = 0 and ts is not null").select(F.col("event_type").alias("symbol"), "ts")
    return quoted_cost(at, quotes)


def quoted_cost(events: DataFrame, quotes: DataFrame, fee: float = 4.0, slip: float = 2.0, tolerance: str = "interval 2 hours", least: float = 0.8) -> DataFrame:
    """Cost of a symbol's events by the spread (90 %) and depth (10 %) that they meet, against the symbol's medians.

    Where under `least` of the events have a quote within the tolerance, the static cost stands and `source` says so.
    """
    base = quotes.groupBy("symbol").agg(F.percentile("spread_bps", F.lit(0.5)).alias("bs"), F.percentile("depth", F.lit(0.5)).alias("bd"))
    m = asof_join(events, quotes, ["symbol"], tolerance=F.expr(tolerance))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    days = F.greatest(F.lit(1.0), (micros(F.max("ts")) - micros(F.min("ts"))) / F.lit(864e8))
    a = m.groupBy("symbol").agg(F.count("*").alias("n"), (F.count("spread_bps") / F.count("*")).alias("coverage"), F.percentile("spread_bps", F.lit(0.9)).alias("s"), F.percentile("depth", F.lit(0.1)).alias("q"), F.greatest(F.lit(1.0), F.sqrt(F.count("*") / days / 5.0)).alias("turnover")).join(base, "symbol", "left")
    tiny = F.lit(1e-6)
    mult = F.least(F.lit(4.0), F.greatest(F.lit(0.5), 0.7 * F.col("s") / F.greatest("bs", tiny) + 0.3 * F.sqrt(F.greatest("bd", tiny) / F.greatest("q", tiny))))
    ok = F.coalesce((F.col("coverage") >= least) & (F.col("s") > 0) & (F.col("q") > 0) & F.col("bs").isNotNull(), F.lit(False))
    a = a.withColumns({"ok": ok, "regime_mult": F.when(ok, mult).otherwise(1.0), "turnover": F.when(ok, F.col("turnover")).otherwise(1.0)})
    return a.select("symbol", "n", r6(F.col("coverage")).alias("coverage"), r6(F.col("regime_mult")).alias("regime_mult"), r6(F.col("turnover")).alias("turnover"), r6(fee + slip * F.col("regime_mult") * F.col("turnover")).alias("cost_bps"), F.when(F.col("ok"), "tob_regime").otherwise("fallback").alias("source"))


@register("shrinkage_p_values")
def shrinkage_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Student's two-sided p of the pooled effects, less 0.05, against their own standard errors."""
    c = candidates(spark, d).withColumn("effect", F.col("effect") - 0.05)
    pooled = pool(c, [["family"], ["family", "state"]])
    t = ratio(F.col("pooled"), F.col("sd") / F.sqrt("n"))
    return pooled.select("family", "state", "unit", "n", r6(F.col("pooled")).alias("pooled"), r6(t).alias("t_stat"), r6(student_two_sided(t, (F.greatest(F.col("n") - 1, F.lit(1))).cast("double"))).alias("p_value"))


# --- streams ---------------------------------------------------------------------------------------------


@register(
    "stream_quotes_agg",
    f"""SELECT event_type AS symbol, time_bucket(INTERVAL 5 MINUTE, e.ts) AS ts, count(*) AS n, {s6('avg(value / 10)')} AS spread_mean, {s6('max(value / 10)')} AS spread_max, {s6('avg(user_id)')} AS depth_mean, min(user_id) AS depth_min
 FROM events e GROUP BY 1, 2 HAVING time_bucket(INTERVAL 5 MINUTE, e.ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_quotes_agg(spark: SparkSession, d: str) -> DataFrame:
    """Quote aggregates of five minutes that a stream over the events has closed by its end."""
    quotes = event_stream(spark, d).select(F.col("event_type").alias("symbol"), "ts", (F.col("value") / 10).alias("spread_bps"), F.col("user_id").alias("depth"))
    rows = _drained(spark, stream_quotes(quotes), "quotes")
    return rows.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "n", *[r6(F.col(c)).alias(c) for c in ("spread_mean", "spread_max", "depth_mean")], "depth_min")


@register(
    "stream_cooldown",
    """WITH RECURSIVE k AS (SELECT event_type, min(ts) AS ts FROM events WHERE event_type IS NOT NULL GROUP BY 1
 UNION ALL SELECT k.event_type, min(e.ts) FROM k JOIN events e ON e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 6 HOUR GROUP BY k.event_type, k.ts)
 SELECT k.event_type, k.ts, min(e.event_id) AS event_id FROM k JOIN events e ON e.event_type = k.event_type AND e.ts = k.ts GROUP BY 1, 2""",
)
def stream_cooldown_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events kept by a stream with six hours between those of a type."""
    kept = _drained(spark, stream_cooldown(event_stream(spark, d), "event_type", pd.Timedelta(hours=6)), "cooldown")
    return kept.select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")
