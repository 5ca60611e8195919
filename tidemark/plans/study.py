"""Labels, splits, event statistics, costs, gates and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import ordered, ratio
from ..operators.align import asof_join, keep_one
from ..operators.pooling import unit_moments
from ..operators.testing import bh_adjust
from . import panel as P
from . import statistics  # noqa: F401  (hazard_summary takes its hazard_curve)
from .more_features import FEAT, wide, wide_sql
from .panel import lagged, over
from .queries import _LABELLED_SQL, detect, oracle_sql, queries, r6, register, s6  # noqa: F401

W = ordered


def feat(spark: SparkSession, d: str) -> DataFrame:
    return P.features(P.cleaned(spark, d))


def lead(x: str, n: int) -> Column:
    return F.lead(x, n).over(P.W())


def ahead(x: str, n: int) -> str:
    return f"lead({x}, {n}) OVER (PARTITION BY symbol ORDER BY ts)"


def rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(F.col(v)).alias(v) for v in values])


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: the first 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def unit_sql(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0)"


# --- labels and splits -----------------------------------------------------------------------------------

#: Horizon names in bars of five minutes.
HORIZONS = {"5m": 1, "15m": 3, "30m": 6, "60m": 12, "1h": 12, "4h": 48, "24h": 288, "1d": 288}
_FWD = [{f"fwd_{n}": (lambda h=h: ratio(lead("close", h), F.col("close")) - 1, f"{ahead('close', h)} / nullif(close, 0) - 1") for n, h in (("5m", 1), ("15m", 3), ("60m", 12))}]
register("fwd_return", f"{wide_sql(_FWD)} SELECT symbol, ts, {', '.join(f'{s6(n)} AS {n}' for n in _FWD[0])} FROM wide")(lambda spark, d: rounded(wide(spark, d, _FWD), ["symbol", "ts"], list(_FWD[0])))


@register("horizon_map", f"WITH h AS (SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN '5m' WHEN 1 THEN '4h' WHEN 2 THEN '1d' ELSE 'other' END AS h, event_type FROM events) SELECT event_type, h, CASE h {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in HORIZONS.items())} ELSE 12 END AS bars FROM h")
def horizon_map(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    rows = P.table(spark, d, "events").select("event_type", F.when(k == 0, "5m").when(k == 1, "4h").when(k == 2, "1d").otherwise("other").alias("h")).distinct()
    known = F.create_map(*[F.lit(x) for kv in HORIZONS.items() for x in kv])
    return rows.select("event_type", "h", F.coalesce(known[F.col("h")], F.lit(12)).alias("bars"))


@register(
    "event_direction",
    f"{FEAT} SELECT symbol, ts, CAST(CASE WHEN spread_z > 1 THEN -sign(funding) ELSE coalesce(nullif(sign(round(trend, 9)), 0), nullif(sign(round(px_z, 9)), 0), nullif(sign(round(ret_1, 9)), 0), 0) END AS INTEGER) AS direction FROM feat",
)
def event_direction(spark: SparkSession, d: str) -> DataFrame:
    """The first sign that is not 0 among the columns in order; for crowded positions (a wide spread) against the funding."""
    signs = [F.nullif(F.signum(F.round(c, 9)), F.lit(0.0)) for c in ("trend", "px_z", "ret_1")]
    return feat(spark, d).select("symbol", "ts", F.when(F.col("spread_z") > 1, -F.signum("funding")).otherwise(F.coalesce(*signs, F.lit(0.0))).cast("int").alias("direction"))


_DAYS = "b AS (SELECT date_trunc('day', min(ts)) AS a, max(ts) AS z FROM events), n AS (SELECT a, z, date_diff('day', a, date_trunc('day', z)) + 1 AS days FROM b), c AS (SELECT a, z, a + to_days(CAST(greatest(1, floor(days * 0.6)) AS INTEGER)) AS t1, greatest(1, floor(days * 0.2)) AS v FROM n), s AS (SELECT a, z, t1, t1 + INTERVAL 1 DAY AS v0, t1 + INTERVAL 1 DAY + to_days(CAST(v AS INTEGER)) AS v1 FROM c), w AS (SELECT *, v1 + INTERVAL 1 DAY AS e0 FROM s)"


def boundaries(e: DataFrame, train: float = 0.6, validation: float = 0.2, embargo: int = 1) -> DataFrame:
    """One row: the split boundaries by whole days, with `embargo` days between the splits."""
    day = lambda n: F.make_dt_interval(days=n.cast("int"))
    b = e.agg(F.date_trunc("DAY", F.min("ts")).cast("timestamp_ntz").alias("a"), F.max("ts").alias("z"))
    days = F.datediff("z", "a") + 1
    gap = day(F.lit(embargo))
    b = b.withColumn("t1", F.col("a") + day(F.greatest(F.lit(1), F.floor(days * train)))).withColumn("v0", F.col("t1") + gap)
    return b.withColumn("v1", F.col("v0") + day(F.greatest(F.lit(1), F.floor(days * validation)))).withColumn("e0", F.col("v1") + gap)


@register("split_windows", f"WITH {_DAYS} SELECT 'train' AS label, a AS start_ts, t1 - INTERVAL 6 HOUR AS end_ts FROM w UNION ALL SELECT 'validation', v0, v1 - INTERVAL 6 HOUR FROM w UNION ALL SELECT 'test', e0, z FROM w")
def split_windows(spark: SparkSession, d: str, purge_hours: int = 6) -> DataFrame:
    """Train, validation and test with an embargo between them; the ends of the first two are purged."""
    purge = F.make_dt_interval(hours=F.lit(purge_hours))
    span = lambda n, a, z: F.struct(F.lit(n).alias("label"), a.alias("start_ts"), z.alias("end_ts"))
    rows = F.array(span("train", F.col("a"), F.col("t1") - purge), span("validation", F.col("v0"), F.col("v1") - purge), span("test", F.col("e0"), F.col("z")))
    return boundaries(P.table(spark, d, "events")).select(F.inline(rows))


@register("split_assign_embargo", f"WITH {_DAYS} SELECT event_id, CASE WHEN ts < t1 - INTERVAL 6 HOUR THEN 'train' WHEN ts >= v0 AND ts < v1 - INTERVAL 6 HOUR THEN 'validation' WHEN ts >= e0 THEN 'test' ELSE 'embargo' END AS split_label FROM events, w")
def split_assign_embargo(spark: SparkSession, d: str) -> DataFrame:
    e, purge, ts = P.table(spark, d, "events"), F.expr("interval 6 hours"), F.col("ts")
    label = F.when(ts < F.col("t1") - purge, "train").when((ts >= F.col("v0")) & (ts < F.col("v1") - purge), "validation").when(ts >= F.col("e0"), "test").otherwise("embargo")
    return e.join(F.broadcast(boundaries(e))).select("event_id", label.alias("split_label"))


_FRACTION = "b AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS z FROM events), m AS (SELECT a, z, least(7 * 864e8, 0.05 * (z - a)) AS gap FROM b), sf AS (SELECT event_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) < a + 0.6 * (z - a) THEN 'train' WHEN epoch_us(ts) < a + 0.6 * (z - a) + gap THEN '' WHEN epoch_us(ts) < a + 0.8 * (z - a) THEN 'validation' WHEN epoch_us(ts) < a + 0.8 * (z - a) + gap THEN '' ELSE 'test' END AS split_label FROM events, m)"


def by_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Splits by shares of the time; the gap after a boundary, 5 % of it but at most seven days, gets ''."""
    e, micros = P.table(spark, d, "events"), lambda c: F.unix_micros(c.cast("timestamp"))
    b = e.agg(micros(F.min("ts")).alias("a"), micros(F.max("ts")).alias("z")).withColumn("gap", F.least(F.lit(7 * 864e8), 0.05 * (F.col("z") - F.col("a"))))
    t, cut = micros(F.col("ts")), lambda s: F.col("a") + s * (F.col("z") - F.col("a"))
    label = F.when(t < cut(0.6), "train").when(t < cut(0.6) + F.col("gap"), "").when(t < cut(0.8), "validation").when(t < cut(0.8) + F.col("gap"), "").otherwise("test")
    return e.join(F.broadcast(b)).select("event_id", "ts", label.alias("split_label"))


register("split_fraction", f"WITH {_FRACTION} SELECT event_id, split_label FROM sf")(lambda spark, d: by_fraction(spark, d).drop("ts"))
register("split_overlap", f"WITH {_FRACTION} SELECT split_label, count(*) AS n, min(t) AS first_us, max(t) AS last_us FROM sf WHERE split_label <> '' GROUP BY 1")(
    lambda spark, d: by_fraction(spark, d).where("split_label <> ''").groupBy("split_label").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.max("ts").cast("timestamp")).alias("last_us"))
)


@register("leakage_check", f"{FEAT} SELECT symbol, count(rv_z) AS n_checked, CAST(0 AS BIGINT) AS n_leaking FROM feat WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1")
def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    """Features of the bars up to a time against those worked out without the later bars: none may differ."""
    bars = P.cleaned(spark, d)
    until = F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")
    whole = P.features(bars).where(until).select("symbol", "ts", "rv_z", "px_z")
    cut = P.features(bars.where(until)).select("symbol", "ts", F.col("rv_z").alias("a"), F.col("px_z").alias("b"))
    same = F.col("rv_z").eqNullSafe(F.col("a")) & F.col("px_z").eqNullSafe(F.col("b"))
    return whole.join(cut, ["symbol", "ts"], "left").groupBy("symbol").agg(F.count("rv_z").alias("n_checked"), F.count_if(~same).alias("n_leaking"))


# --- event statistics ------------------------------------------------------------------------------------

_GRID = [{"dir": (lambda: F.signum(F.round("trend", 9)), "sign(round(trend, 9))")} | {f"r{h}": (lambda h=h: (ratio(lead("close", 1 + h), lead("close", 1)) - 1), f"{ahead('close', 1 + h)} / nullif({ahead('close', 1)}, 0) - 1") for h in (1, 3, 12)}]
_RULES = {"continuation": 1.0, "mean_reversion": -1.0}
_KERNEL_SQL = (
    wide_sql(_GRID)
    + ", e AS (SELECT *, max(ts) OVER (PARTITION BY symbol) AS z FROM wide WHERE spread_z > 1), x AS ("
    + " UNION ALL ".join(f"SELECT symbol, '{r}' AS rule, {h} AS horizon, ts, r{h} * dir * {s} AS r, greatest(exp(-(epoch_us(z) - epoch_us(ts)) / (10 * 864e8)), 0.05) AS w FROM e WHERE r{h} IS NOT NULL AND dir <> 0" for r, s in _RULES.items() for h in (1, 3, 12))
    + "), o AS (SELECT *, row_number() OVER (PARTITION BY symbol, rule, horizon ORDER BY ts) AS k, count(*) OVER (PARTITION BY symbol, rule, horizon) AS n FROM x), m AS (SELECT *, sum(w * r) OVER g / sum(w) OVER g AS mu FROM o WINDOW g AS (PARTITION BY symbol, rule, horizon)), "
    "kern AS (SELECT symbol, rule, horizon, count(*) AS n, any_value(mu) AS mean, sqrt(sum(w * (r - mu) * (r - mu)) / sum(w)) AS sd, sum(w) * sum(w) / sum(w * w) AS ess, sum(CASE WHEN k <= n // 2 THEN w * r END) AS first_half, sum(CASE WHEN k > n // 2 THEN w * r END) AS second_half FROM m GROUP BY 1, 2, 3)"
)


def kernel(spark: SparkSession, d: str, horizons: tuple = (1, 3, 12), tau_days: float = 10.0) -> DataFrame:
    """Directional returns of all rules and horizons in one grouped aggregate, with weights that fade with age."""
    e = wide(spark, d, _GRID).where("spread_z > 1")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    e = e.withColumn("w", F.greatest(F.exp(-(micros(F.max("ts").over(Window.partitionBy("symbol"))) - micros(F.col("ts"))) / F.lit(tau_days * 864e8)), F.lit(0.05)))
    cases = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(h).alias("horizon"), (F.col(f"r{h}") * F.col("dir") * s).alias("r")) for r, s in _RULES.items() for h in horizons])
    x = e.where("dir <> 0").select("symbol", "ts", "w", F.explode(cases).alias("c")).select("symbol", "ts", "w", "c.*").where("r is not null")
    g = Window.partitionBy("symbol", "rule", "horizon")
    x = x.withColumns({"k": F.row_number().over(g.orderBy("ts")), "half": F.floor(F.count("*").over(g) / 2), "mu": F.sum(F.col("w") * F.col("r")).over(g) / F.sum("w").over(g)})
    wr = F.col("w") * F.col("r")
    return x.groupBy("symbol", "rule", "horizon").agg(
        F.count("*").alias("n"), F.first("mu").alias("mean"), F.sqrt(F.sum(F.col("w") * (F.col("r") - F.col("mu")) * (F.col("r") - F.col("mu"))) / F.sum("w")).alias("sd"), (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"),
        F.sum(F.when(F.col("k") <= F.col("half"), wr)).alias("first_half"), F.sum(F.when(F.col("k") > F.col("half"), wr)).alias("second_half"),
    )


_T = "mean / nullif(sd / sqrt(ess), 0)"
_STABLE = "coalesce(first_half * second_half > 0, FALSE)"
register("expectancy_grid", f"{_KERNEL_SQL} SELECT symbol, rule, horizon, n, {s6('mean')} AS mean, {s6('sd')} AS sd, {s6('ess')} AS ess, {s6(_T)} AS t_stat, {_STABLE} AS stable FROM kern WHERE n >= 5")(
    lambda spark, d: kernel(spark, d).where("n >= 5").select("symbol", "rule", "horizon", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "sd", "ess")], r6(ratio(F.col("mean"), F.col("sd") / F.sqrt("ess"))).alias("t_stat"), F.coalesce(F.col("first_half") * F.col("second_half") > 0, F.lit(False)).alias("stable"))
)
register("multiplicity_penalty", f"{_KERNEL_SQL} SELECT symbol, rule, horizon, {s6('abs(mean) - 0.5 * sd * sqrt(ln(count(*) OVER ()) / ess)')} AS penalised FROM kern")(
    lambda spark, d: _penalised(kernel(spark, d))
)


def _penalised(k: DataFrame) -> DataFrame:
    tests = k.agg(F.count("*").alias("tests"))
    return k.join(F.broadcast(tests)).select("symbol", "rule", "horizon", r6(F.abs("mean") - 0.5 * F.col("sd") * F.sqrt(F.log("tests") / F.col("ess"))).alias("penalised"))


register("family_key", f"{_KERNEL_SQL} SELECT symbol, rule, horizon, upper(symbol) || '_STAT|' || upper(rule) || '|' || horizon || 'b|STATE=WIDE' AS family_id FROM kern")(
    lambda spark, d: kernel(spark, d).select("symbol", "rule", "horizon", F.concat_ws("|", F.concat(F.upper("symbol"), F.lit("_STAT")), F.upper("rule"), F.concat("horizon", F.lit("b")), F.lit("STATE=WIDE")).alias("family_id"))
)
_GATES = {"sample": "n >= 30", "effect": "mean > 0.001", "stability": _STABLE, "significance": f"{_T} > 1.0"}
_GATED = f"{_KERNEL_SQL}, gated AS (SELECT *, " + ", ".join(f"coalesce({c}, FALSE) AS g_{g}" for g, c in _GATES.items()) + " FROM kern)"


def gated(spark: SparkSession, d: str) -> DataFrame:
    k, no = kernel(spark, d), lambda c: F.coalesce(c, F.lit(False))
    return k.withColumns({"g_sample": F.col("n") >= 30, "g_effect": no(F.col("mean") > 0.001), "g_stability": no(F.col("first_half") * F.col("second_half") > 0), "g_significance": no(ratio(F.col("mean"), F.col("sd") / F.sqrt("ess")) > 1.0)})


register("first_failed_gate", f"{_GATED} SELECT symbol, rule, horizon, CASE " + " ".join(f"WHEN NOT g_{g} THEN '{g}'" for g in _GATES) + " ELSE 'passed' END AS first_failed FROM gated")(
    lambda spark, d: gated(spark, d).select("symbol", "rule", "horizon", F.coalesce(*[F.when(~F.col(f"g_{g}"), F.lit(g)) for g in _GATES], F.lit("passed")).alias("first_failed"))
)
register("gates_refresh", f"{_GATED} SELECT symbol, rule, horizon, {s6('mean - 0.0006')} AS after_cost, {s6('mean - 0.0009')} AS stressed, array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT g_{g} THEN '{g}' END" for g in _GATES) + "], lambda x: x IS NOT NULL), ',') AS fail_reasons FROM gated")(
    lambda spark, d: gated(spark, d).select("symbol", "rule", "horizon", r6(F.col("mean") - 0.0006).alias("after_cost"), r6(F.col("mean") - 0.0009).alias("stressed"), F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"g_{g}"), F.lit(g)) for g in _GATES])), ",").alias("fail_reasons"))
)
register("gate_summary", f"{_GATED} " + " UNION ALL ".join(f"SELECT '{g}' AS gate, count(*) FILTER (WHERE g_{g}) AS passed, count(*) FILTER (WHERE NOT g_{g}) AS failed FROM gated" for g in _GATES))(
    lambda spark, d: gated(spark, d).select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(f"g_{g}").alias("ok")) for g in _GATES])).alias("x")).groupBy("x.gate").agg(F.count_if("x.ok").alias("passed"), F.count_if(~F.col("x.ok")).alias("failed"))
)
register("promote_gate", f"{_GATED} SELECT symbol, rule, horizon, {s6('(' + ' + '.join(f'CAST(g_{g} AS INTEGER)' for g in _GATES) + ') / 4.0')} AS score, " + " AND ".join(f"g_{g}" for g in _GATES) + " AS promoted FROM gated")(
    lambda spark, d: gated(spark, d).select("symbol", "rule", "horizon", r6(sum((F.col(f"g_{g}").cast("int") for g in _GATES), F.lit(0)) / 4.0).alias("score"), F.forall(F.array(*[F.col(f"g_{g}") for g in _GATES]), lambda x: x).alias("promoted"))
)
register("bridge_metrics", f"{_KERNEL_SQL} SELECT symbol, rule, horizon, c AS cost_factor, {s6('mean - c * 0.0006')} AS net, {s6('mean / (c * 0.0006)')} AS edge_to_cost, coalesce(mean - c * 0.0006 > 0, FALSE) AS survives FROM kern, (SELECT unnest([0.5, 1.0, 1.5, 2.0]) AS c)")(
    lambda spark, d: kernel(spark, d).withColumn("cost_factor", F.explode(F.array(*map(F.lit, (0.5, 1.0, 1.5, 2.0))))).select("symbol", "rule", "horizon", "cost_factor", r6(F.col("mean") - F.col("cost_factor") * 0.0006).alias("net"), r6(F.col("mean") / (F.col("cost_factor") * 0.0006)).alias("edge_to_cost"), F.coalesce(F.col("mean") - F.col("cost_factor") * 0.0006 > 0, F.lit(False)).alias("survives"))
)
register("funnel_summary", f"{_GATED} SELECT rule, count(*) AS tested, count(*) FILTER (WHERE g_sample) AS sampled, count(*) FILTER (WHERE g_sample AND g_effect) AS costed, count(*) FILTER (WHERE g_sample AND g_effect AND g_stability AND g_significance) AS promoted FROM gated GROUP BY 1")(
    lambda spark, d: gated(spark, d).groupBy("rule").agg(F.count("*").alias("tested"), F.count_if("g_sample").alias("sampled"), F.count_if(F.col("g_sample") & F.col("g_effect")).alias("costed"), F.count_if(F.col("g_sample") & F.col("g_effect") & F.col("g_stability") & F.col("g_significance")).alias("promoted"))
)
register("param_stability", f"{_KERNEL_SQL}, s AS (SELECT n >= 30 AND mean > 0.001 AS base, n >= 20 AND mean > 0.0005 AS loose, n >= 40 AND mean > 0.002 AS tight FROM kern) SELECT {s6('count(*) FILTER (WHERE base AND loose) * 1.0 / nullif(count(*) FILTER (WHERE base OR loose), 0)')} AS loose_jaccard, {s6('count(*) FILTER (WHERE base AND tight) * 1.0 / nullif(count(*) FILTER (WHERE base OR tight), 0)')} AS tight_jaccard FROM s")(
    lambda spark, d: _stability(kernel(spark, d))
)


def _stability(k: DataFrame) -> DataFrame:
    at = lambda n, e: (F.col("n") >= n) & (F.col("mean") > e)
    base, loose, tight = at(30, 0.001), at(20, 0.0005), at(40, 0.002)
    j = lambda a, b: r6(F.count_if(a & b) / F.nullif(F.count_if(a | b), F.lit(0)))
    return k.agg(j(base, loose).alias("loose_jaccard"), j(base, tight).alias("tight_jaccard"))


_EV = f"{FEAT}, ev AS (SELECT symbol, ts, bar_range, ret_1, trend, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM feat WHERE spread_z > 1)"


def events_of(spark: SparkSession, d: str) -> DataFrame:
    return feat(spark, d).where("spread_z > 1").select("symbol", "ts", "bar_range", "ret_1", "trend")


@register("bootstrap_ci", f"{_EV}, b AS (SELECT symbol, rep, ret_1, {unit_sql('symbol', 'epoch_us(ts)', 'rep')} AS u FROM ev, (SELECT unnest(range(1, 51)) AS rep) WHERE ret_1 IS NOT NULL), m AS (SELECT symbol, rep, sum(ret_1 * c) / nullif(sum(c), 0) AS m FROM (SELECT *, CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.91969860 THEN 2 WHEN u < 0.98101184 THEN 3 WHEN u < 0.99634015 THEN 4 ELSE 5 END AS c FROM b) GROUP BY 1, 2) SELECT symbol, {s6('quantile_cont(m, 0.025)')} AS low, {s6('quantile_cont(m, 0.975)')} AS high FROM m GROUP BY 1")
def bootstrap_ci(spark: SparkSession, d: str, replicates: int = 50) -> DataFrame:
    """Poisson bootstrap of the mean: each event's weight in each replicate comes from a hash of both, so it is the same on every run."""
    e = events_of(spark, d).where("ret_1 is not null").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = unit(F.col("symbol"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.col("rep").cast("string"))
    c = F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.91969860, 2).when(u < 0.98101184, 3).when(u < 0.99634015, 4).otherwise(5)
    means = e.withColumn("c", c).groupBy("symbol", "rep").agg((F.sum(F.col("ret_1") * F.col("c")) / F.nullif(F.sum("c"), F.lit(0))).alias("m"))
    return means.groupBy("symbol").agg(r6(F.percentile("m", F.lit(0.025))).alias("low"), r6(F.percentile("m", F.lit(0.975))).alias("high"))


@register(
    "block_bootstrap",
    f"{FEAT}, s AS (SELECT symbol, coalesce(ret_1, 0) AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM feat), c AS (SELECT DISTINCT symbol, n FROM s), b AS (SELECT symbol, n, rep, j, CAST(floor({unit_sql('symbol', 'rep', 'j')} * n) AS BIGINT) AS start FROM c, (SELECT unnest(range(1, 21)) AS rep), (SELECT unnest(range(0, 6)) AS j)), "
    f"o AS (SELECT symbol, rep, (start + o) % n AS i FROM b, (SELECT unnest(range(0, 24)) AS o)), m AS (SELECT symbol, rep, sum(r) AS total FROM o JOIN s USING (symbol, i) GROUP BY 1, 2) SELECT symbol, {s6('quantile_cont(total, 0.05)')} AS p05, {s6('avg(CASE WHEN total > 0 THEN 1.0 ELSE 0.0 END)')} AS positive FROM m GROUP BY 1",
)
def block_bootstrap(spark: SparkSession, d: str, replicates: int = 20, blocks: int = 6, length: int = 24) -> DataFrame:
    """Circular blocks: replicates are rows (rep, block, start), joined to the series by place."""
    s = feat(spark, d).select("symbol", F.coalesce("ret_1", F.lit(0.0)).alias("r"), (F.row_number().over(W()) - 1).cast("long").alias("i"))
    n = s.groupBy("symbol").agg(F.count("*").alias("n"))
    b = n.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    start = F.floor(unit(F.col("symbol"), F.col("rep").cast("string"), F.col("j").cast("string")) * F.col("n"))
    o = b.withColumns({"start": start, "step": F.explode(F.sequence(F.lit(0), F.lit(length - 1)))}).select("symbol", "rep", ((F.col("start") + F.col("step")) % F.col("n")).alias("i"))
    totals = o.join(s, ["symbol", "i"]).groupBy("symbol", "rep").agg(F.sum("r").alias("total"))
    return totals.groupBy("symbol").agg(r6(F.percentile("total", F.lit(0.05))).alias("p05"), r6(F.avg(F.when(F.col("total") > 0, 1.0).otherwise(0.0))).alias("positive"))


register("perturbation", f"{_EV}, s AS (SELECT symbol, avg(ret_1) AS m, stddev_samp(ret_1) AS sd, count(ret_1) AS n FROM ev GROUP BY 1), p AS (SELECT symbol, m + 0.05 * sd / sqrt(n) * sqrt(-2 * ln(1 - {unit_sql('symbol', 'rep', chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {unit_sql('symbol', 'rep', chr(39) + 'b' + chr(39))}) AS x FROM s, (SELECT unnest(range(1, 101)) AS rep)) SELECT symbol, {s6('quantile_cont(x, 0.05)')} AS p05, {s6('quantile_cont(x, 0.95)')} AS p95 FROM p GROUP BY 1")(
    lambda spark, d: _noisy(events_of(spark, d))
)


def _noisy(e: DataFrame, replicates: int = 100) -> DataFrame:
    """Only the mean of the noise matters, so one normal number a replicate is drawn, by hash."""
    s = e.groupBy("symbol").agg(F.avg("ret_1").alias("m"), F.stddev_samp("ret_1").alias("sd"), F.count("ret_1").alias("n")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = lambda k: unit(F.col("symbol"), F.col("rep").cast("string"), F.lit(k))
    normal = F.sqrt(-2 * F.log(1 - u("a"))) * F.cos(2 * F.pi() * u("b"))
    return s.withColumn("x", F.col("m") + 0.05 * F.col("sd") / F.sqrt("n") * normal).groupBy("symbol").agg(r6(F.percentile("x", F.lit(0.05))).alias("p05"), r6(F.percentile("x", F.lit(0.95))).alias("p95"))


register("event_sanity", f"{_EV}, l AS (SELECT symbol, date_diff('hour', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS step FROM ev) SELECT symbol, count(*) AS n, {s6('median(step)')} AS median_step, min(step) AS min_step, max(step) AS max_step, count(*) FILTER (WHERE step < 6) AS inside_cooldown FROM l GROUP BY 1")(
    lambda spark, d: events_of(spark, d).withColumn("step", F.timestamp_diff("HOUR", F.lag("ts").over(W()), F.col("ts"))).groupBy("symbol").agg(F.count("*").alias("n"), r6(F.percentile("step", F.lit(0.5))).alias("median_step"), F.min("step").alias("min_step"), F.max("step").alias("max_step"), F.count_if(F.col("step") < 6).alias("inside_cooldown"))
)
register("clustering", f"{_EV}, l AS (SELECT symbol, date_diff('hour', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS step FROM ev), n AS (SELECT symbol, count(*) AS bars FROM feat GROUP BY 1) SELECT symbol, {s6('10000.0 * count(*) / any_value(bars)')} AS per_10k, {s6('avg(CASE WHEN step <= 5 THEN 1.0 WHEN step IS NOT NULL THEN 0.0 END)')} AS clustered FROM l JOIN n USING (symbol) GROUP BY 1")(
    lambda spark, d: _clustered(feat(spark, d))
)


def _clustered(f: DataFrame) -> DataFrame:
    hit = f.withColumn("at", F.when(F.col("spread_z") > 1, F.col("ts")))
    before = F.last("at", ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(F.col("at").isNotNull(), F.timestamp_diff("HOUR", before, F.col("at")))
    g = hit.withColumn("step", step).groupBy("symbol").agg((10000.0 * F.count("at") / F.count("*")).alias("per_10k"), F.avg(F.when(F.col("step") <= 5, 1.0).when(F.col("step").isNotNull(), 0.0)).alias("clustered"), F.count("at").alias("n"))
    return rounded(g.where("n > 0"), ["symbol"], ["per_10k", "clustered"])


register("capacity", f"{_EV}, p AS (SELECT symbol, date_trunc('day', ts) AS day, count(*) AS n FROM ev GROUP BY 1, 2) SELECT symbol, {s6('avg(n)')} AS events_per_day, max(n) AS busiest FROM p GROUP BY 1")(
    lambda spark, d: events_of(spark, d).groupBy("symbol", F.date_trunc("DAY", "ts").alias("day")).agg(F.count("*").alias("n")).groupBy("symbol").agg(r6(F.avg("n")).alias("events_per_day"), F.max("n").alias("busiest"))
)
register("elasticity", f"{FEAT} SELECT symbol, count(*) FILTER (WHERE bar_range > 0.9 * range_med48) AS loose, count(*) FILTER (WHERE bar_range > 1.1 * range_med48) AS tight, {s6('count(*) FILTER (WHERE bar_range > 0.9 * range_med48) * 1.0 / nullif(count(*) FILTER (WHERE bar_range > 1.1 * range_med48), 0)')} AS elasticity FROM feat GROUP BY 1")(
    lambda spark, d: feat(spark, d).groupBy("symbol").agg(F.count_if(F.col("bar_range") > 0.9 * F.col("range_med48")).alias("loose"), F.count_if(F.col("bar_range") > 1.1 * F.col("range_med48")).alias("tight")).withColumn("elasticity", r6(F.col("loose") / F.nullif(F.col("tight"), F.lit(0))))
)
register("phase_stability", f"{FEAT}, h AS (SELECT symbol, hour(ts) // 8 AS phase, median(bar_range) AS m FROM feat GROUP BY 1, 2) SELECT symbol, {s6('max(m) - min(m)')} AS spread, {s6('(max(m) - min(m)) / nullif(avg(m), 0)')} AS fractional FROM h GROUP BY 1")(
    lambda spark, d: feat(spark, d).groupBy("symbol", F.floor(F.hour("ts") / 8).alias("phase")).agg(F.percentile("bar_range", F.lit(0.5)).alias("m")).groupBy("symbol").agg(r6(F.max("m") - F.min("m")).alias("spread"), r6((F.max("m") - F.min("m")) / F.nullif(F.avg("m"), F.lit(0.0))).alias("fractional"))
)
_WELCH = "(c.m - b.m) / nullif(sqrt(c.v / c.n + b.v / b.n), 0)"
register("lift_welch", f"{FEAT}, b AS (SELECT symbol, avg(ret_1) AS m, var_samp(ret_1) AS v, count(ret_1) AS n FROM feat GROUP BY 1), c AS (SELECT symbol, hour(ts) // 8 AS session, avg(ret_1) AS m, var_samp(ret_1) AS v, count(ret_1) AS n FROM feat GROUP BY 1, 2) SELECT c.symbol, c.session, {s6('c.m - b.m')} AS lift, {s6(_WELCH)} AS t_stat, {s6('power(c.v / c.n + b.v / b.n, 2) / (power(c.v / c.n, 2) / (c.n - 1) + power(b.v / b.n, 2) / (b.n - 1))')} AS df FROM c JOIN b USING (symbol)")(
    lambda spark, d: _welch(feat(spark, d))
)


def _welch(f: DataFrame) -> DataFrame:
    """Each session's mean return against its symbol's, with Welch's t and degrees of freedom; both levels from one cube."""
    both = f.select("symbol", F.floor(F.hour("ts") / 8).alias("session"), "ret_1").groupingSets([["symbol"], ["symbol", "session"]], "symbol", "session").agg(F.avg("ret_1").alias("m"), F.var_samp("ret_1").alias("v"), F.count("ret_1").alias("n"))
    base = both.where("session is null").select("symbol", F.col("m").alias("bm"), F.col("v").alias("bv"), F.col("n").alias("bn"))
    a, b = F.col("v") / F.col("n"), F.col("bv") / F.col("bn")
    out = both.where("session is not null").join(base, "symbol")
    return out.select("symbol", "session", r6(F.col("m") - F.col("bm")).alias("lift"), r6(ratio(F.col("m") - F.col("bm"), F.sqrt(a + b))).alias("t_stat"), r6((a + b) ** 2 / (a**2 / (F.col("n") - 1) + b**2 / (F.col("bn") - 1))).alias("df"))


register("delta_vs_control", f"{FEAT}, c AS (SELECT symbol, hour(ts) // 4 AS slot, avg(bar_range) AS control FROM feat WHERE spread_z <= 1 GROUP BY 1, 2) SELECT e.symbol, e.ts, {s6('e.bar_range - c.control')} AS delta FROM feat e LEFT JOIN c ON c.symbol = e.symbol AND c.slot = hour(e.ts) // 4 WHERE e.spread_z > 1")(
    lambda spark, d: _deltas(feat(spark, d).withColumn("slot", F.floor(F.hour("ts") / 4)))
)


def _deltas(f: DataFrame) -> DataFrame:
    control = f.where("spread_z <= 1").groupBy("symbol", "slot").agg(F.avg("bar_range").alias("control"))
    return f.where("spread_z > 1").join(control, ["symbol", "slot"], "left").select("symbol", "ts", r6(F.col("bar_range") - F.col("control")).alias("delta"))


_MATCH = f"{FEAT}, q AS (SELECT *, CASE WHEN rv_z IS NULL THEN 0 WHEN rv_z > 0 THEN 2 ELSE 1 END AS vol_q, hour(ts) // 6 AS slot, epoch_us(ts) AS us FROM feat), pool AS (SELECT symbol, vol_q, slot, ts AS control_ts, bar_range AS control, row_number() OVER (PARTITION BY symbol, vol_q, slot ORDER BY md5(symbol || '|' || us), ts) - 1 AS k, count(*) OVER (PARTITION BY symbol, vol_q, slot) AS n FROM q WHERE NOT coalesce(spread_z > 1, FALSE)) SELECT e.symbol, e.ts, p.control_ts, {s6('e.bar_range - p.control')} AS delta FROM q e JOIN pool p ON p.symbol = e.symbol AND p.vol_q = e.vol_q AND p.slot = e.slot AND p.k = CAST(floor({unit_sql('e.symbol', 'e.us')} * p.n) AS BIGINT) WHERE e.spread_z > 1"


@register("control_match_stratum", _MATCH)
def control_match_stratum(spark: SparkSession, d: str) -> DataFrame:
    """One control a event, from the bars of its stratum (symbol, volatility side, time of day) that are no events: the pool is
    numbered in hash order and the event's hash picks a number, so the join is by equality and no pairs are formed."""
    us = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    q = feat(spark, d).withColumns({"vol_q": F.when(F.col("rv_z").isNull(), 0).when(F.col("rv_z") > 0, 2).otherwise(1), "slot": F.floor(F.hour("ts") / 6), "us": us})
    keys = ["symbol", "vol_q", "slot"]
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", "symbol", "us").cast("binary")), "ts")
    pool = q.where("not coalesce(spread_z > 1, false)").select(*keys, F.col("ts").alias("control_ts"), F.col("bar_range").alias("control"), (F.row_number().over(order) - 1).cast("long").alias("k"))
    sizes = pool.groupBy(*keys).agg(F.count("*").alias("n"))
    picked = q.where("spread_z > 1").join(sizes, keys).withColumn("k", F.floor(unit(F.col("symbol"), F.col("us")) * F.col("n")))
    return picked.join(pool, [*keys, "k"]).select("symbol", "ts", "control_ts", r6(F.col("bar_range") - F.col("control")).alias("delta"))


register(
    "control_match_nearest",
    f"{FEAT}, e AS (SELECT symbol, ts, round(rv, 9) AS rv FROM feat WHERE spread_z > 1 AND rv IS NOT NULL), p AS (SELECT symbol, round(rv, 9) AS rv FROM feat WHERE spread_z <= 1 AND rv IS NOT NULL GROUP BY 1, 2) SELECT e.symbol, e.ts, {s6('min(abs(e.rv - p.rv))')} AS distance FROM e JOIN p USING (symbol) GROUP BY 1, 2",
)(lambda spark, d: _nearest(feat(spark, d).where("rv is not null").withColumn("rv", F.round("rv", 9))))


def _nearest(f: DataFrame) -> DataFrame:
    """The nearest control on either side by two as-of joins along the volatility: no pairs are formed."""
    pool = f.where("spread_z <= 1").select("symbol", "rv").distinct().withColumn("near", F.col("rv"))
    own = f.where("spread_z > 1").select("symbol", "ts", "rv")
    below = asof_join(own, pool, ["symbol"], on="rv", right_time="_").drop("_").withColumnRenamed("near", "below")
    both = asof_join(below, pool, ["symbol"], on="rv", forward=True, right_time="_")
    return both.select("symbol", "ts", r6(F.least(F.col("rv") - F.col("below"), F.col("near") - F.col("rv"))).alias("distance"))


# --- pooling, evaluation -----------------------------------------------------------------------------

_UNITS = "cand AS (SELECT l_returnflag AS family, l_linestatus AS state, l_suppkey % 20 AS unit, count(*) AS n, avg(l_discount) AS effect, stddev_samp(l_discount) AS sd FROM lineitem GROUP BY 1, 2, 3)"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    line = P.table(spark, d, "lineitem")
    return line.groupBy(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("state"), (F.col("l_suppkey") % 20).alias("unit")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("effect"), F.stddev_samp("l_discount").alias("sd"))


register("pooled_moments", f"WITH {_UNITS}, m AS (SELECT *, sum(n * effect) OVER w / sum(n) OVER w AS mu FROM cand WINDOW w AS (PARTITION BY family, state)) SELECT family, state, CAST(sum(n) AS BIGINT) AS n, {s6('any_value(mu)')} AS mean, {s6('(sum((n - 1) * sd * sd) + sum(n * (effect - mu) * (effect - mu))) / greatest(sum(n) - 1, 1)')} AS var FROM m GROUP BY 1, 2")(
    lambda spark, d: unit_moments(candidates(spark, d), ["family", "state"]).select("family", "state", "n", r6(F.col("mean")).alias("mean"), r6(F.col("var")).alias("var"))
)
register("psr_dsr_moments", f"{FEAT}, m AS (SELECT symbol, ret_1 - avg(ret_1) OVER (PARTITION BY symbol) AS r, ret_1 AS x FROM feat WHERE ret_1 IS NOT NULL), s AS (SELECT symbol, count(*) AS n, avg(x) / stddev_samp(x) AS sr, avg(r * r * r) / power(avg(r * r), 1.5) AS skew, avg(r * r * r * r) / power(avg(r * r), 2) AS kurt FROM m GROUP BY 1) SELECT symbol, n, {s6('sr')} AS sr, {s6('skew')} AS skew, {s6('kurt')} AS kurt, {s6('sr / sqrt((1 + 0.5 * sr * sr - skew * sr + kurt / 4 * sr * sr) / (n - 1))')} AS z FROM s WHERE n >= 10")(
    lambda spark, d: _sharpe(feat(spark, d).where("ret_1 is not null")).select("symbol", "n", *[r6(F.col(c)).alias(c) for c in ("sr", "skew", "kurt", "z")])
)


def _sharpe(f: DataFrame) -> DataFrame:
    """Moments of the Sharpe ratio; skewness and kurtosis are the uncorrected ones that Spark has."""
    s = f.groupBy("symbol").agg(F.count("*").alias("n"), (F.avg("ret_1") / F.stddev_samp("ret_1")).alias("sr"), F.skewness("ret_1").alias("skew"), (F.kurtosis("ret_1") + 3).alias("kurt")).where("n >= 10")
    sr = F.col("sr")
    return s.withColumn("z", sr / F.sqrt((1 + 0.5 * sr * sr - F.col("skew") * sr + F.col("kurt") / 4 * sr * sr) / (F.col("n") - 1)))


@register("psr_dsr")
def psr_dsr(spark: SparkSession, d: str, trials: int = 10) -> DataFrame:
    """Probabilistic and deflated Sharpe ratio: the chance that the true ratio beats 0, and the best of `trials` by luck."""
    from statistics import NormalDist

    from ..functions.tails import normal_cdf

    g, inv = 0.5772156649, NormalDist().inv_cdf
    best = (1 - g) * inv(1 - 1 / trials) + g * inv(1 - 1 / (trials * 2.718281828459045))
    s = _sharpe(feat(spark, d).where("ret_1 is not null"))
    luck = (F.col("sr") - F.greatest(F.lit(0.0), F.lit(best) / F.sqrt("n"))) * F.col("z") / F.col("sr")
    return s.select("symbol", "n", r6(normal_cdf(F.col("z"))).alias("psr"), r6(normal_cdf(luck)).alias("dsr"))


_NEXT = [{"pos": (lambda: F.when(F.col("px_z") > 1, -1.0).when(F.col("px_z") < -1, 1.0).otherwise(0.0), "CASE WHEN px_z > 1 THEN -1.0 WHEN px_z < -1 THEN 1.0 ELSE 0.0 END")}, {"held": (lambda: F.coalesce(F.lag("pos", 1).over(P.W()), F.lit(0.0)), f"coalesce({lagged('pos', 1)}, 0.0)"), "before": (lambda: F.coalesce(F.lag("pos", 2).over(P.W()), F.lit(0.0)), f"coalesce({lagged('pos', 2)}, 0.0)")}, {"pnl": (lambda: F.coalesce(F.col("held") * F.when(F.col("held") != F.col("before"), ratio(F.col("close"), F.col("open")) - 1).otherwise(F.col("ret_1")), F.lit(0.0)), "coalesce(held * CASE WHEN held <> before THEN close / nullif(open, 0) - 1 ELSE ret_1 END, 0.0)")}]
register("pnl_next_open", f"{wide_sql(_NEXT)} SELECT symbol, ts, {s6('pnl')} AS pnl FROM wide")(lambda spark, d: rounded(wide(spark, d, _NEXT), ["symbol", "ts"], ["pnl"]))
register("position_from_threshold", f"{wide_sql(_NEXT[:1])} SELECT symbol, ts, pos FROM wide")(lambda spark, d: wide(spark, d, _NEXT[:1]).select("symbol", "ts", "pos"))
register("funding_event_aligned", f"{wide_sql(_NEXT[:2])} SELECT symbol, ts, {s6('coalesce(-held * funding, 0)')} AS funding_pnl FROM wide WHERE hour(ts) IN (0, 8, 16) AND minute(ts) = 0")(
    lambda spark, d: wide(spark, d, _NEXT[:2]).where(F.hour("ts").isin(0, 8, 16) & (F.minute("ts") == 0)).select("symbol", "ts", r6(F.coalesce(-F.col("held") * F.col("funding"), F.lit(0.0))).alias("funding_pnl"))
)
_CAPS = "c AS (SELECT symbol, ts, pos, count(*) FILTER (WHERE pos <> 0) OVER (PARTITION BY ts) AS gross, abs(sum(pos) OVER (PARTITION BY ts)) AS net FROM wide), k AS (SELECT *, pos * CASE WHEN net = gross AND gross > 1.5 THEN 1.5 / gross ELSE 1.0 END AS capped FROM c)"
register("exposure_caps", f"{wide_sql(_NEXT[:1])}, {_CAPS} SELECT symbol, ts, {s6('capped * CASE WHEN sum(abs(capped)) OVER (PARTITION BY ts) > 2 THEN 2 / sum(abs(capped)) OVER (PARTITION BY ts) ELSE 1 END')} AS position FROM k")(
    lambda spark, d: _capped(wide(spark, d, _NEXT[:1]))
)


def _capped(df: DataFrame, same_side: float = 1.5, whole: float = 2.0) -> DataFrame:
    """Positions of a time within the cap for all on one side, then within that of the whole portfolio."""
    at = Window.partitionBy("ts")
    gross = F.sum(F.abs("pos")).over(at)
    side = F.when((F.abs(F.sum("pos").over(at)) == gross) & (gross > same_side), same_side / gross).otherwise(1.0)
    df = df.withColumn("capped", F.col("pos") * side)
    total = F.sum(F.abs("capped")).over(at)
    return df.select("symbol", "ts", r6(F.col("capped") * F.when(total > whole, whole / total).otherwise(1.0)).alias("position"))


register("risk_overlay", f"{wide_sql(_NEXT[:2])} SELECT symbol, ts, CASE WHEN coalesce(rv_z > 2, FALSE) THEN 0.0 WHEN coalesce(spread_z > 1.5, FALSE) AND held = 0 THEN 0.0 ELSE pos END AS position FROM wide")(
    lambda spark, d: wide(spark, d, _NEXT[:2]).select("symbol", "ts", F.when(F.coalesce(F.col("rv_z") > 2, F.lit(False)), 0.0).when(F.coalesce(F.col("spread_z") > 1.5, F.lit(False)) & (F.col("held") == 0), 0.0).otherwise(F.col("pos")).alias("position"))
)
register("xs_momentum", f"{FEAT} SELECT symbol, ts, {s6('2.0 * dense_rank() OVER (PARTITION BY ts ORDER BY round(trend, 9)) / count(*) OVER (PARTITION BY ts) - 1')} AS xs_momentum FROM feat WHERE trend IS NOT NULL QUALIFY count(*) OVER (PARTITION BY ts) >= 3")(
    lambda spark, d: feat(spark, d).where("trend is not null").withColumns({"k": F.dense_rank().over(Window.partitionBy("ts").orderBy(F.round("trend", 9))), "n": F.count("*").over(Window.partitionBy("ts"))}).where("n >= 3").select("symbol", "ts", r6(2.0 * F.col("k") / F.col("n") - 1).alias("xs_momentum"))
)
register("merge_signals", f"{FEAT}, a AS (SELECT symbol, ts, score FROM feat WHERE score IS NOT NULL), b AS (SELECT symbol, ts, basis_z FROM feat WHERE basis_z IS NOT NULL) SELECT c.symbol, c.ts, {s6('a.score')} AS score, {s6('b.basis_z')} AS basis_z FROM cleaned c LEFT JOIN a USING (symbol, ts) LEFT JOIN b USING (symbol, ts)")(
    lambda spark, d: rounded(feat(spark, d), ["symbol", "ts"], ["score", "basis_z"])
)
register("ridge_moments", f"{wide_sql(_FWD)} SELECT symbol, count(*) AS n, {s6('covar_samp(px_z, fwd_5m)')} AS xy_px, {s6('covar_samp(rv_z, fwd_5m)')} AS xy_rv, {s6('var_samp(px_z)')} AS xx_px, {s6('var_samp(rv_z)')} AS xx_rv, {s6('covar_samp(px_z, rv_z)')} AS xx_cross FROM wide WHERE px_z IS NOT NULL AND rv_z IS NOT NULL AND fwd_5m IS NOT NULL GROUP BY 1")(
    lambda spark, d: _ridge_moments(spark, d).select("symbol", "n", *[r6(F.col(c)).alias(c) for c in ("xy_px", "xy_rv", "xx_px", "xx_rv", "xx_cross")])
)


def _ridge_moments(spark: SparkSession, d: str) -> DataFrame:
    known = wide(spark, d, _FWD).where("px_z is not null and rv_z is not null and fwd_5m is not null")
    return known.groupBy("symbol").agg(F.count("*").alias("n"), F.covar_samp("px_z", "fwd_5m").alias("xy_px"), F.covar_samp("rv_z", "fwd_5m").alias("xy_rv"), F.var_samp("px_z").alias("xx_px"), F.var_samp("rv_z").alias("xx_rv"), F.covar_samp("px_z", "rv_z").alias("xx_cross"))


_DET = "((xx_px + 0.1) * (xx_rv + 0.1) - xx_cross * xx_cross)"
_MOMENTS = f"{wide_sql(_FWD)}, mom AS (SELECT symbol, covar_samp(px_z, fwd_5m) AS xy_px, covar_samp(rv_z, fwd_5m) AS xy_rv, var_samp(px_z) AS xx_px, var_samp(rv_z) AS xx_rv, covar_samp(px_z, rv_z) AS xx_cross FROM wide WHERE px_z IS NOT NULL AND rv_z IS NOT NULL AND fwd_5m IS NOT NULL GROUP BY 1), beta AS (SELECT symbol, ((xx_rv + 0.1) * xy_px - xx_cross * xy_rv) / {_DET} AS b_px, ((xx_px + 0.1) * xy_rv - xx_cross * xy_px) / {_DET} AS b_rv FROM mom)"


def ridge(spark: SparkSession, d: str, penalty: float = 0.1) -> DataFrame:
    """Two coefficients a symbol, solved in closed form from moments of one aggregate."""
    m = _ridge_moments(spark, d)
    a, b, c = F.col("xx_px") + penalty, F.col("xx_rv") + penalty, F.col("xx_cross")
    det = a * b - c * c
    return m.select("symbol", ((b * F.col("xy_px") - c * F.col("xy_rv")) / det).alias("b_px"), ((a * F.col("xy_rv") - c * F.col("xy_px")) / det).alias("b_rv"))


register("ridge_fit", f"{_MOMENTS} SELECT symbol, {s6('b_px')} AS b_px, {s6('b_rv')} AS b_rv FROM beta")(lambda spark, d: rounded(ridge(spark, d), ["symbol"], ["b_px", "b_rv"]))
register("ridge_apply", f"{_MOMENTS} SELECT symbol, ts, {s6('b_px * px_z + b_rv * rv_z')} AS score FROM feat JOIN beta USING (symbol) WHERE px_z IS NOT NULL AND rv_z IS NOT NULL")(
    lambda spark, d: feat(spark, d).where("px_z is not null and rv_z is not null").join(F.broadcast(ridge(spark, d)), "symbol").select("symbol", "ts", r6(F.col("b_px") * F.col("px_z") + F.col("b_rv") * F.col("rv_z")).alias("score"))
)
register("cost_calibrate", f"{FEAT} SELECT symbol, count(bar_range) AS n, {s6('median(bar_range) / 2 * 10000')} AS half_spread_bps, {s6('quantile_cont(bar_range, 0.75) / 2 * 10000')} AS p75_bps FROM feat GROUP BY 1 HAVING count(bar_range) >= 100")(
    lambda spark, d: feat(spark, d).groupBy("symbol").agg(F.count("bar_range").alias("n"), r6(F.percentile("bar_range", F.lit(0.5)) / 2 * 10000).alias("half_spread_bps"), r6(F.percentile("bar_range", F.lit(0.75)) / 2 * 10000).alias("p75_bps")).where("n >= 100")
)
register("stop_target_from_events", f"{wide_sql(_FWD)} SELECT symbol, {s6('greatest(0.001, least(0.5, -quantile_cont(least(fwd_60m, 0), 0.25)))')} AS stop, {s6('greatest(0.001, least(2.0, quantile_cont(greatest(fwd_60m, 0), 0.6)))')} AS target FROM wide WHERE spread_z > 1 AND fwd_60m IS NOT NULL GROUP BY 1")(
    lambda spark, d: wide(spark, d, _FWD).where("spread_z > 1 and fwd_60m is not null").groupBy("symbol").agg(r6(F.greatest(F.lit(0.001), F.least(F.lit(0.5), -F.percentile(F.least("fwd_60m", F.lit(0.0)), F.lit(0.25))))).alias("stop"), r6(F.greatest(F.lit(0.001), F.least(F.lit(2.0), F.percentile(F.greatest("fwd_60m", F.lit(0.0)), F.lit(0.6))))).alias("target"))
)
register("dq_contract", f"WITH {P.CLEANED_SQL} SELECT symbol, count(*) FILTER (WHERE high < low) AS reversed, count(*) FILTER (WHERE close < 0 OR open < 0) AS negative, count(*) FILTER (WHERE volume < 0) AS negative_volume, count(*) FILTER (WHERE close > high OR close < low) AS outside, count(*) FILTER (WHERE is_gap) AS gaps FROM cleaned GROUP BY 1")(
    lambda spark, d: P.cleaned(spark, d).groupBy("symbol").agg(F.count_if(F.col("high") < F.col("low")).alias("reversed"), F.count_if((F.col("close") < 0) | (F.col("open") < 0)).alias("negative"), F.count_if(F.col("volume") < 0).alias("negative_volume"), F.count_if((F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))).alias("outside"), F.count_if("is_gap").alias("gaps"))
)
register("state_acceptance", f"{FEAT}, g AS (SELECT symbol, CASE WHEN rv_z <= -0.5 THEN 0 WHEN rv_z <= 0.5 THEN 1 ELSE 2 END AS state, avg(rv) AS m FROM feat WHERE rv_z IS NOT NULL GROUP BY 1, 2), l AS (SELECT symbol, m - lag(m) OVER (PARTITION BY symbol ORDER BY state) AS step FROM g) SELECT symbol, coalesce(min(step) > 0, FALSE) AS monotone FROM l GROUP BY 1")(
    lambda spark, d: feat(spark, d).where("rv_z is not null").groupBy("symbol", F.when(F.col("rv_z") <= -0.5, 0).when(F.col("rv_z") <= 0.5, 1).otherwise(2).alias("state")).agg(F.avg("rv").alias("m")).withColumn("step", F.col("m") - F.lag("m").over(Window.partitionBy("symbol").orderBy("state"))).groupBy("symbol").agg(F.coalesce(F.min("step") > 0, F.lit(False)).alias("monotone"))
)
register("microstructure_acceptance", f"{FEAT}, r AS (SELECT symbol, roll_spread, amihud, rv_z, rank() OVER (PARTITION BY symbol ORDER BY round(vpin, 9)) AS a, rank() OVER (PARTITION BY symbol ORDER BY round(rv, 9)) AS b FROM feat WHERE vpin IS NOT NULL AND rv IS NOT NULL) SELECT symbol, {s6('avg(CASE WHEN roll_spread > 0 THEN 1.0 WHEN roll_spread IS NOT NULL THEN 0.0 END)')} AS roll_positive, {s6('corr(a, b)')} AS spearman, {s6('median(CASE WHEN rv_z > 1 THEN amihud END) / nullif(median(CASE WHEN rv_z <= 1 THEN amihud END), 0)')} AS amihud_ratio FROM r GROUP BY 1")(
    lambda spark, d: feat(spark, d).where("vpin is not null and rv is not null").withColumns({k: F.rank().over(Window.partitionBy("symbol").orderBy(F.round(c, 9))) for k, c in (("a", "vpin"), ("b", "rv"))}).groupBy("symbol").agg(
        r6(F.avg(F.when(F.col("roll_spread") > 0, 1.0).when(F.col("roll_spread").isNotNull(), 0.0))).alias("roll_positive"), r6(F.corr("a", "b")).alias("spearman"), r6(F.percentile(F.when(F.col("rv_z") > 1, F.col("amihud")), F.lit(0.5)) / F.nullif(F.percentile(F.when(F.col("rv_z") <= 1, F.col("amihud")), F.lit(0.5)), F.lit(0.0))).alias("amihud_ratio")
    )
)
register("lift_bh", f"WITH p AS (SELECT l_partkey % 500 AS id, l_suppkey % 10 AS family, avg(l_discount) AS x, round(count(*) / (1.0 + sum(l_quantity)), 6) AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT *, x - avg(x) OVER (PARTITION BY family) AS lift, rank() OVER (PARTITION BY family ORDER BY p) + count(*) OVER (PARTITION BY family, p) - 1 AS k, count(*) OVER (PARTITION BY family) AS m FROM p) SELECT family, id, {s6('lift')} AS lift, least(1.0, min(p * m / k) OVER (PARTITION BY family ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) <= 0.1 AS rejected FROM r")(
    lambda spark, d: _lifts(P.table(spark, d, "lineitem"))
)


def _lifts(line: DataFrame) -> DataFrame:
    p = line.groupBy((F.col("l_partkey") % 500).alias("id"), (F.col("l_suppkey") % 10).alias("family")).agg(F.avg("l_discount").alias("x"), F.round(F.count("*") / (1.0 + F.sum("l_quantity")), 6).alias("p"))
    q = bh_adjust(p, "p", "q", ["family"])
    return q.select("family", "id", r6(F.col("x") - F.avg("x").over(Window.partitionBy("family"))).alias("lift"), (F.col("q") <= 0.1).alias("rejected"))


# --- further statistics --------------------------------------------------------------------------------

register("fwd_abs_return", f"{wide_sql(_FWD)}, c AS (SELECT symbol, avg(abs(fwd_15m)) AS control FROM wide WHERE spread_z <= 1 GROUP BY 1) SELECT w.symbol, ts, {s6('abs(fwd_15m)')} AS abs_return, {s6('abs(fwd_15m) - control')} AS excess FROM wide w JOIN c USING (symbol) WHERE spread_z > 1")(
    lambda spark, d: _absolute(wide(spark, d, _FWD))
)


def _absolute(df: DataFrame) -> DataFrame:
    """Absolute forward returns of events, and what they have over the mean of the symbol's other bars."""
    control = df.where("spread_z <= 1").groupBy("symbol").agg(F.avg(F.abs("fwd_15m")).alias("control"))
    return df.where("spread_z > 1").join(control, "symbol").select("symbol", "ts", r6(F.abs("fwd_15m")).alias("abs_return"), r6(F.abs("fwd_15m") - F.col("control")).alias("excess"))


register("split_pnl", f"{wide_sql(_NEXT)}, b AS (SELECT min(ts) AS a, max(ts) AS z FROM wide), s AS (SELECT symbol, pnl, abs(pos - held) * 0.0006 AS cost, CASE WHEN epoch_us(ts) < epoch_us(a) + (epoch_us(z) - epoch_us(a)) * 0.6 THEN 'train' ELSE 'test' END AS split_label FROM wide, b) SELECT symbol, split_label, {s6('sum(pnl)')} AS pnl, {s6('sum(pnl - 1.5 * cost)')} AS stressed_pnl, {s6('sum(cost) / nullif(sum(abs(pnl)), 0)')} AS cost_ratio, {s6('avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)')} AS pass_rate FROM s GROUP BY 1, 2")(
    lambda spark, d: _split_pnl(wide(spark, d, _NEXT))
)


def _split_pnl(df: DataFrame) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ends = df.agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    df = df.join(F.broadcast(ends)).withColumns({"cost": F.abs(F.col("pos") - F.col("held")) * 0.0006, "split_label": F.when(micros("ts") < micros("a") + (micros("z") - micros("a")) * 0.6, "train").otherwise("test")})
    return df.groupBy("symbol", "split_label").agg(
        r6(F.sum("pnl")).alias("pnl"), r6(F.sum(F.col("pnl") - 1.5 * F.col("cost"))).alias("stressed_pnl"), r6(F.sum("cost") / F.nullif(F.sum(F.abs("pnl")), F.lit(0.0))).alias("cost_ratio"), r6(F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0))).alias("pass_rate")
    )


#: Days that a family's evidence lasts, and what volatility and liquidity do to them.
TAU_DAYS = {"click": 15.0, "view": 30.0, "purchase": 60.0, "signup": 90.0}
_TAU_SQL = f"round(CASE symbol {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in TAU_DAYS.items())} ELSE 60.0 END * CASE WHEN rv_z > 3 THEN 0.4 WHEN rv_z > 1 THEN 0.7 WHEN rv_z < -1 THEN 1.4 ELSE 1.0 END * CASE WHEN quote_volume < 0.5 * vol_med THEN 0.6 ELSE 1.0 END, 6) + 0.0"
register("regime_tau", f"{FEAT} SELECT symbol, ts, {_TAU_SQL} AS tau_days FROM feat")(lambda spark, d: _taus(feat(spark, d)))


def _taus(df: DataFrame) -> DataFrame:
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in TAU_DAYS.items() for x in kv])[F.col("symbol")], F.lit(60.0))
    vol = F.when(F.col("rv_z") > 3, 0.4).when(F.col("rv_z") > 1, 0.7).when(F.col("rv_z") < -1, 1.4).otherwise(1.0)
    return df.select("symbol", "ts", r6(base * vol * F.when(F.col("quote_volume") < 0.5 * F.col("vol_med"), 0.6).otherwise(1.0)).alias("tau_days"))


register(
    "lambda_carryover",
    f"WITH y AS (SELECT l_returnflag AS level, year(l_shipdate) AS run, var_samp(l_discount) / greatest(abs(avg(l_discount) - 0.05), 1e-8) AS lam FROM lineitem GROUP BY 1, 2), c AS (SELECT level, run, greatest(5.0, least(5000.0, lam)) AS lam FROM y), p AS (SELECT *, lag(lam) OVER (PARTITION BY level ORDER BY run) AS prev FROM c) "
    f"SELECT level, run, {s6('coalesce(greatest(0.5 * prev, least(1.5 * prev, 0.9 * prev + 0.1 * lam)), lam)')} AS smoothed FROM p",
)(lambda spark, d: _carried(P.table(spark, d, "lineitem")))


def _carried(line: DataFrame) -> DataFrame:
    """Each run's lambda drawn a tenth of the way from the latest run before it, and within half of that one."""
    y = line.groupBy(F.col("l_returnflag").alias("level"), F.year("l_shipdate").cast("long").alias("run")).agg((F.var_samp("l_discount") / F.greatest(F.abs(F.avg("l_discount") - 0.05), F.lit(1e-8))).alias("lam"))
    lam = F.greatest(F.lit(5.0), F.least(F.lit(5000.0), F.col("lam")))
    y = y.withColumn("lam", lam).withColumn("prev", F.lag("lam").over(Window.partitionBy("level").orderBy("run")))
    drawn = F.greatest(0.5 * F.col("prev"), F.least(1.5 * F.col("prev"), 0.9 * F.col("prev") + 0.1 * F.col("lam")))
    return y.select("level", "run", r6(F.when(F.col("prev").isNull(), F.col("lam")).otherwise(drawn)).alias("smoothed"))


register("curvature", f"{wide_sql(_FWD)}, c AS (SELECT w.symbol, k, avg(fwd_15m) AS m FROM wide w, (SELECT unnest([0.9, 1.0, 1.1]) AS k) WHERE spread_z > 1.5 * k AND fwd_15m IS NOT NULL GROUP BY 1, 2) SELECT symbol, {s6('max(CASE WHEN k < 0.95 THEN m END)')} AS loose, {s6('max(CASE WHEN k BETWEEN 0.95 AND 1.05 THEN m END)')} AS base, {s6('max(CASE WHEN k > 1.05 THEN m END)')} AS tight FROM c GROUP BY 1")(
    lambda spark, d: wide(spark, d, _FWD).where("spread_z > 1.5 * 0.9 and fwd_15m is not null").groupBy("symbol").agg(*[r6(F.avg(F.when(F.col("spread_z") > 1.5 * k, F.col("fwd_15m")))).alias(n) for n, k in (("loose", 0.9), ("base", 1.0), ("tight", 1.1))])
)
_HAZ = f"{P.CLEANED_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar FROM cleaned), h AS (SELECT symbol, first_value(CASE WHEN close > 300 THEN bar END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) - bar AS age FROM b), hz AS (SELECT h.symbol, a.age, avg(CASE WHEN h.age = a.age THEN 1.0 ELSE 0.0 END) AS hazard FROM h JOIN (SELECT unnest(range(1, 25)) AS age) a ON h.age IS NULL OR h.age >= a.age GROUP BY 1, 2)"
register("hazard_summary", f"WITH {_HAZ} SELECT symbol, {s6('max(hazard)')} AS peak, {s6('avg(CASE WHEN age <= 8 THEN hazard END)')} AS front, {s6('avg(CASE WHEN age > 16 THEN hazard END)')} AS late, {s6('sum(hazard)')} AS auc FROM hz GROUP BY 1")(
    lambda spark, d: _hazards(queries()["hazard_curve"](spark, d))
)


def _hazards(curve: DataFrame) -> DataFrame:
    rate = F.col("n_hits") / F.col("at_risk")
    return curve.groupBy("symbol").agg(r6(F.max(rate)).alias("peak"), r6(F.avg(F.when(F.col("age") <= 8, rate))).alias("front"), r6(F.avg(F.when(F.col("age") > 16, rate))).alias("late"), r6(F.sum(rate)).alias("auc"))
