"""More registered queries: conditions, labels, event and series statistics, data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import ordered, zscore
from ..operators.testing import bh_adjust, simes
from . import panel as P
from .queries import ORACLES, QUERIES, Query, r6, s6

W = ordered


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def feat(spark: SparkSession, d: str) -> DataFrame:
    return P.features(P.cleaned(spark, d))


FEAT = f"WITH {P.features_sql()}"
#: Conditions over the panel; the same text in both engines.
CONDITIONS = {
    "cond_numeric": "px_z > 1.0",
    "cond_in_range": "px_z BETWEEN -0.5 AND 0.5",
    "cond_session_asia": "hour(ts) BETWEEN 0 AND 7",
    "cond_session_us": "hour(ts) BETWEEN 16 AND 23",
    "cond_all": "px_z > 0.5 AND rv_z > 0.0",
    "cond_any": "px_z > 2.0 OR rv_z > 2.0",
}
LAGGED = {
    "cond_lookback": ("prev > 1.0", "lag(px_z, 3) OVER (PARTITION BY symbol ORDER BY ts)"),
    "cond_crosses_above": ("prev <= 0.5 AND px_z > 0.5", "lag(px_z, 1) OVER (PARTITION BY symbol ORDER BY ts)"),
    "cond_crosses_below": ("prev >= -0.5 AND px_z < -0.5", "lag(px_z, 1) OVER (PARTITION BY symbol ORDER BY ts)"),
}
for _n, _c in CONDITIONS.items():
    register(_n, f"{FEAT} SELECT symbol, ts FROM feat WHERE {_c}")(lambda spark, d, c=_c: feat(spark, d).where(c).select("symbol", "ts"))
for _n, (_c, _prev) in LAGGED.items():
    register(_n, f"{FEAT} SELECT symbol, ts FROM (SELECT *, {_prev} AS prev FROM feat) WHERE {_c}")(lambda spark, d, c=_c, p=_prev: feat(spark, d).withColumn("prev", F.expr(p)).where(c).select("symbol", "ts"))
register("cond_zscore", f"{FEAT} SELECT symbol, ts FROM (SELECT symbol, ts, {P.z('bar_range', 24, 24)} AS z FROM feat) WHERE z > 1.5")(
    lambda spark, d: feat(spark, d).select("symbol", "ts", zscore(F.col("bar_range"), 24).alias("z")).where("z > 1.5").select("symbol", "ts")
)


@register(
    "condition_fanout",
    f"{FEAT}, fw AS (SELECT *, lead(close, 4) OVER (PARTITION BY symbol ORDER BY ts) / nullif(lead(close, 1) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS fwd FROM feat) "
    + " UNION ALL ".join(f"SELECT '{n}' AS condition_name, symbol, count(fwd) AS n, {s6('avg(fwd)')} AS mean_fwd, {s6('stddev_samp(fwd)')} AS sd_fwd FROM fw WHERE {c} GROUP BY symbol" for n, c in CONDITIONS.items()),
)
def condition_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Forward returns under every condition, in one pass: rows are fanned out to the conditions they fulfil."""
    df = feat(spark, d).withColumn("fwd", F.lead("close", 4).over(W()) / F.nullif(F.lead("close", 1).over(W()), F.lit(0.0)) - 1)
    names = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in CONDITIONS.items()]))
    g = df.select("symbol", "fwd", F.explode(names).alias("condition_name")).groupBy("condition_name", "symbol")
    return g.agg(F.count("fwd").alias("n"), r6(F.avg("fwd")).alias("mean_fwd"), r6(F.stddev_samp("fwd")).alias("sd_fwd"))


register("parse_bool", "SELECT event_id, coalesce(value > 100, FALSE) OR lower(trim(event_type)) IN ('purchase', 'signup') AS flag FROM events")(
    lambda spark, d: P.table(spark, d, "events").select("event_id", (F.coalesce(F.col("value").cast("string").try_cast("double") > 100, F.lit(False)) | F.lower(F.trim("event_type")).isin("purchase", "signup")).alias("flag"))
)


@register(
    "severity_bucket",
    f"{FEAT}, q AS (SELECT symbol, quantile_cont(bar_range, 0.8) AS a, quantile_cont(bar_range, 0.9) AS b, quantile_cont(bar_range, 0.95) AS c FROM feat GROUP BY symbol) SELECT symbol, ts, CASE WHEN bar_range >= c THEN 'extreme_5' WHEN bar_range >= b THEN 'top_10' WHEN bar_range >= a THEN 'top_20' ELSE 'base' END AS severity FROM feat JOIN q USING (symbol) WHERE bar_range IS NOT NULL",
)
def severity_bucket(spark: SparkSession, d: str) -> DataFrame:
    df = feat(spark, d).where("bar_range is not null").select("symbol", "ts", "bar_range")
    edges = df.groupBy("symbol").agg(F.percentile("bar_range", F.array(F.lit(0.8), F.lit(0.9), F.lit(0.95))).alias("e"))
    x = F.col("bar_range")
    return df.join(edges, "symbol").select("symbol", "ts", F.when(x >= F.col("e")[2], "extreme_5").when(x >= F.col("e")[1], "top_10").when(x >= F.col("e")[0], "top_20").otherwise("base").alias("severity"))


@register(
    "global_pct_rank",
    f"{FEAT} SELECT symbol, ts, {s6('(rank() OVER (PARTITION BY symbol ORDER BY ret_1) + (count(*) OVER (PARTITION BY symbol, ret_1) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol)')} AS pct FROM feat WHERE ret_1 IS NOT NULL",
)
def global_pct_rank(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("symbol")
    ties = F.count("*").over(Window.partitionBy("symbol", "ret_1"))
    return feat(spark, d).where("ret_1 is not null").select("symbol", "ts", r6((F.rank().over(by.orderBy("ret_1")) + (ties - 1) / 2.0) / F.count("*").over(by)).alias("pct"))


_HIT = "first_value(CASE WHEN close > 300 THEN bar END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) - bar"


@register(
    "hazard_curve",
    f"WITH {P.CLEANED_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar FROM cleaned), h AS (SELECT symbol, {_HIT} AS age FROM b), a AS (SELECT unnest(range(1, 25)) AS age) "
    f"SELECT h.symbol, CAST(a.age AS INTEGER) AS age, count(*) AS at_risk, sum(CASE WHEN h.age = a.age THEN 1 ELSE 0 END)::BIGINT AS n_hits, {s6('avg(CASE WHEN h.age = a.age THEN 1.0 ELSE 0.0 END)')} AS hazard FROM h JOIN a ON h.age IS NULL OR h.age >= a.age GROUP BY 1, 2",
)
def hazard_curve(spark: SparkSession, d: str) -> DataFrame:
    curve = hazards(P.cleaned(spark, d), F.col("close") > 300)
    return curve.select("symbol", "age", "at_risk", "n_hits", r6(F.col("n_hits") / F.col("at_risk")).alias("hazard"))


def hazards(bars: DataFrame, hit: Column, ages: int = 24) -> DataFrame:
    """(symbol, age, at_risk, n_hits) of the bars until the next hit; those at risk are what a running sum from the oldest age
    leaves, so ages are not exploded."""
    df = bars.withColumn("bar", F.row_number().over(W()).cast("long"))
    age = (F.first(F.when(hit, F.col("bar")), ignorenulls=True).over(W().rowsBetween(1, ages)) - F.col("bar")).cast("int")
    hits = df.select("symbol", age.alias("age")).groupBy("symbol", "age").agg(F.count("*").alias("n"))
    grid = hits.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(1), F.lit(ages))).alias("age"))
    never = hits.where("age is null").select("symbol", F.col("n").alias("never"))
    full = grid.join(hits.where("age is not null"), ["symbol", "age"], "left").join(never, "symbol", "left").fillna(0, ["n", "never"])
    left = F.sum("n").over(Window.partitionBy("symbol").orderBy(F.desc("age")).rowsBetween(Window.unboundedPreceding, 0)) + F.col("never")
    return full.withColumn("at_risk", left).where("at_risk > 0").select("symbol", "age", "at_risk", F.col("n").alias("n_hits"))


@register(
    "time_decay_weight",
    "WITH e AS (SELECT event_type, value, greatest(exp(-(epoch_us(max(ts) OVER (PARTITION BY event_type)) - epoch_us(ts)) / 864e9), 0.05) AS w FROM events) SELECT event_type, "
    + f"{s6('sum(w * value) / sum(w)')} AS weighted_mean, {s6('sum(w) * sum(w) / sum(w * w)')} AS ess FROM e GROUP BY 1",
)
def time_decay_weight(spark: SparkSession, d: str) -> DataFrame:
    e = P.table(spark, d, "events")
    last = e.groupBy("event_type").agg(F.max("ts").alias("z"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = e.join(last, "event_type").withColumn("w", F.greatest(F.exp(-(micros("z") - micros("ts")) / F.lit(864e9)), F.lit(0.05)))
    return e.groupBy("event_type").agg(r6(F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("weighted_mean"), r6(F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"))


@register(
    "psi_drift",
    "WITH q AS (SELECT quantile_cont(l_extendedprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM lineitem WHERE l_returnflag = 'N'), "
    "b AS (SELECT l_returnflag = 'N' AS ref, CASE " + " ".join(f"WHEN l_extendedprice < e[{i + 2}] THEN {i}" for i in range(9)) + " ELSE 9 END AS bin FROM lineitem, q WHERE l_extendedprice BETWEEN e[1] AND e[11]), "
    "c AS (SELECT bin, sum(CASE WHEN ref THEN 1 ELSE 0 END) AS r, sum(CASE WHEN ref THEN 0 ELSE 1 END) AS l FROM b GROUP BY bin), t AS (SELECT greatest(r / sum(r) OVER (), 1e-9) AS r, greatest(l / sum(l) OVER (), 1e-9) AS l FROM c) "
    f"SELECT {s6('sum((l - r) * ln(l / r))')} AS psi FROM t",
)
def psi_drift(spark: SparkSession, d: str) -> DataFrame:
    line = P.table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "N").alias("ref"))
    edges = line.where("ref").agg(F.percentile("l_extendedprice", F.array(*[F.lit(i / 10) for i in range(11)])).alias("e"))  # one row
    x = F.col("l_extendedprice")
    bin_ = reduce(lambda c, i: c.when(x < F.col("e")[i + 1], i), range(1, 9), F.when(x < F.col("e")[1], 0)).otherwise(9)
    counts = line.join(F.broadcast(edges)).where(x.between(F.col("e")[0], F.col("e")[10])).groupBy(bin_.alias("bin")).agg(F.sum(F.col("ref").cast("int")).alias("r"), F.sum((~F.col("ref")).cast("int")).alias("l"))
    sums = counts.agg(F.sum("r").alias("rs"), F.sum("l").alias("ls"))
    shares = counts.join(F.broadcast(sums)).select(F.greatest(F.col("r") / F.col("rs"), F.lit(1e-9)).alias("r"), F.greatest(F.col("l") / F.col("ls"), F.lit(1e-9)).alias("l"))
    return shares.agg(r6(F.sum((F.col("l") - F.col("r")) * F.log(F.col("l") / F.col("r")))).alias("psi"))


register(
    "dq_outliers",
    "WITH m AS (SELECT event_type, avg(value) AS a, stddev_samp(value) AS s FROM events GROUP BY 1) SELECT event_type, count(*) AS n, sum(CASE WHEN abs(value - a) > 2 * s THEN 1 ELSE 0 END)::BIGINT AS outliers, count(DISTINCT value) = 1 AS constant FROM events JOIN m USING (event_type) GROUP BY 1",
)(
    lambda spark, d: P.table(spark, d, "events").join(P.table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("a"), F.stddev_samp("value").alias("s")), "event_type").groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(F.when(F.abs(F.col("value") - F.col("a")) > 2 * F.col("s"), 1).otherwise(0)).alias("outliers"), (F.min("value") == F.max("value")).alias("constant")
    )
)
register("dq_grid", f"WITH {P.BARS_SQL}, l AS (SELECT symbol, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS step FROM bars) SELECT symbol, count(*) AS n, sum(CASE WHEN step <> INTERVAL 1 HOUR THEN 1 ELSE 0 END)::BIGINT AS off_grid FROM l GROUP BY 1")(
    lambda spark, d: P.bars(spark, d).select("symbol", (F.col("ts") - F.lag("ts").over(W())).alias("step")).groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.when(F.col("step") != F.expr("interval 1 hour"), 1).otherwise(0)).alias("off_grid"))
)
register("freshness", "SELECT event_type, CAST(floor((epoch(TIMESTAMP '2024-02-01') - epoch(max(ts))) / 3600) AS BIGINT) AS bars_stale FROM events GROUP BY 1")(
    lambda spark, d: P.table(spark, d, "events").groupBy("event_type").agg(F.floor((F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))) / F.lit(3600e6)).alias("bars_stale"))
)
_P = "p AS (SELECT l_partkey % 500 AS id, l_suppkey % 10 AS family, round(count(*) / (1.0 + sum(l_quantity)), 6) AS p FROM lineitem GROUP BY 1, 2)"


@register(
    "two_stage_fdr",
    f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k, rank() OVER (PARTITION BY family ORDER BY p) + count(*) OVER (PARTITION BY family, p) - 1 AS kk, count(*) OVER (PARTITION BY family) AS m FROM p), "
    "s AS (SELECT family, least(1.0, min(p * m / k)) AS sp FROM r GROUP BY family), f AS (SELECT *, rank() OVER (ORDER BY sp) + count(*) OVER (PARTITION BY sp) - 1 AS k, count(*) OVER () AS m FROM s), "
    "g AS (SELECT family, least(1.0, min(sp * m / k) OVER (ORDER BY sp DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS fq FROM f), "
    "q AS (SELECT family, id, least(1.0, min(p * m / kk) OVER (PARTITION BY family ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r) "
    f"SELECT q.family, id, {s6('fq')} AS family_q, {s6('CASE WHEN fq <= 0.2 THEN q ELSE 1.0 END')} AS q FROM q JOIN g USING (family)",
)
def two_stage_fdr(spark: SparkSession, d: str) -> DataFrame:
    p = P.table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 500).alias("id"), (F.col("l_suppkey") % 10).alias("family")).agg(F.round(F.count("*") / (1.0 + F.sum("l_quantity")), 6).alias("p"))
    families = bh_adjust(simes(p, "p", ["family"]), "simes_p", "family_q", [])
    return bh_adjust(p, "p", "q", ["family"]).join(families, "family").select("family", "id", r6(F.col("family_q")).alias("family_q"), r6(F.when(F.col("family_q") <= 0.2, F.col("q")).otherwise(1.0)).alias("q"))


@register(
    "monthly_topn_universe",
    "WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS month FROM orders), d AS (SELECT date_trunc('day', o_orderdate) AS day, o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2), s AS (SELECT m.month, d.o_custkey, round(sum(v), 2) AS v FROM m JOIN d ON d.day >= m.month - INTERVAL 30 DAY AND d.day < m.month GROUP BY 1, 2), "
    "seed AS (SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderdate), o_custkey) AS k FROM orders GROUP BY 1) WHERE k <= 5), e AS (SELECT month, o_custkey, v FROM s UNION ALL SELECT month, o_custkey, -1 AS v FROM m, seed WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.month = m.month AND s.o_custkey = seed.o_custkey)) "
    "SELECT month, o_custkey, k FROM (SELECT month, o_custkey, row_number() OVER (PARTITION BY month ORDER BY v DESC, o_custkey) AS k FROM e) WHERE k <= 5",
)
def monthly_topn_universe(spark: SparkSession, d: str, top: int = 5, look_back: int = 30) -> DataFrame:
    """The five customers of each month with the most in the 30 days before it; the earliest five customers fill months that lack some.

    A day's sum goes to the months that begin within the 30 days after it, one or two, so days and months are not paired.
    """
    orders = P.table(spark, d, "orders")
    month = lambda c: F.date_trunc("MONTH", c).cast("timestamp_ntz")
    months = orders.select(month(F.col("o_orderdate")).alias("month")).distinct()
    daily = orders.groupBy(F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz").alias("day"), "o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    later = F.filter(F.array(*[month(F.add_months("day", i)) for i in (1, 2)]), lambda x: x <= F.col("day") + F.make_dt_interval(days=F.lit(look_back)))
    sums = daily.select("o_custkey", "v", F.explode(later).alias("month")).groupBy("month", "o_custkey").agg(F.round(F.sum("v"), 2).alias("v")).join(F.broadcast(months), "month")
    seed = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("t")).orderBy("t", "o_custkey").limit(top).select("o_custkey")
    fill = months.crossJoin(F.broadcast(seed)).join(sums.select("month", "o_custkey"), ["month", "o_custkey"], "left_anti").select("month", "o_custkey", F.lit(-1.0).alias("v"))
    ranked = sums.select("month", "o_custkey", "v").unionByName(fill).withColumn("k", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("v"), "o_custkey")).cast("long"))
    return ranked.where(F.col("k") <= top).select("month", "o_custkey", "k")


register("listing_snapshot", "SELECT l_suppkey, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts, max(l_shipdate) >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 7 DAY AS active FROM lineitem GROUP BY 1")(
    lambda spark, d: P.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("first_ts"), F.max("l_shipdate").alias("last_ts")).join(F.broadcast(P.table(spark, d, "lineitem").agg(F.max("l_shipdate").alias("z")))).select("l_suppkey", "first_ts", "last_ts", (F.col("last_ts") >= F.col("z") - F.expr("interval 7 days")).alias("active"))
)
register("tail_report", f"{FEAT}, r AS (SELECT symbol, ret_1, row_number() OVER (PARTITION BY symbol ORDER BY ret_1 DESC, ts) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM feat WHERE ret_1 IS NOT NULL) SELECT symbol, {s6('sum(CASE WHEN k <= ceil(0.05 * n) THEN ret_1 ELSE 0 END) / sum(ret_1)')} AS top5_share FROM r GROUP BY symbol")(
    lambda spark, d: feat(spark, d).where("ret_1 is not null").withColumns({"k": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ret_1"), "ts")), "n": F.count("*").over(Window.partitionBy("symbol"))}).groupBy("symbol").agg(r6(F.sum(F.when(F.col("k") <= F.ceil(F.lit(0.05) * F.col("n")), F.col("ret_1")).otherwise(0.0)) / F.sum("ret_1")).alias("top5_share"))
)
register("year_stability", f"WITH y AS (SELECT l_returnflag, year(l_shipdate) AS y, avg(l_discount) - 0.05 AS m FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, count(*) AS n, {s6('avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_share FROM y GROUP BY 1")(
    lambda spark, d: P.table(spark, d, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("y")).agg((F.avg("l_discount") - 0.05).alias("m")).groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("m") > 0, 1.0).otherwise(0.0))).alias("positive_share"))
)
register("benchmarks", f"{FEAT}, j AS (SELECT a.ret_1 AS x, b.ret_1 AS y FROM feat a JOIN feat b ON a.ts = b.ts WHERE a.symbol = 'click' AND b.symbol = 'view') SELECT count(*) AS n, {s6('regr_slope(y, x)')} AS beta, {s6('regr_r2(y, x)')} AS r2 FROM j WHERE x IS NOT NULL AND y IS NOT NULL")(
    lambda spark, d: feat(spark, d).where("symbol = 'click'").select("ts", F.col("ret_1").alias("x")).join(feat(spark, d).where("symbol = 'view'").select("ts", F.col("ret_1").alias("y")), "ts").where("x is not null and y is not null").agg(F.count("*").alias("n"), r6(F.regr_slope("y", "x")).alias("beta"), r6(F.regr_r2("y", "x")).alias("r2"))
)
register("loss_clusters", f"{FEAT}, f AS (SELECT symbol, ts, coalesce(ret_1 < 0, FALSE) AS loss FROM feat), g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, loss ORDER BY ts) AS g FROM f), r AS (SELECT symbol, g, count(*) AS n FROM g WHERE loss GROUP BY 1, 2) SELECT symbol, count(*) AS runs, max(n) AS longest, {s6('avg(n)')} AS mean_run FROM r GROUP BY symbol")(
    lambda spark, d: _loss_runs(feat(spark, d)).groupBy("symbol").agg(F.count("*").alias("runs"), F.max("n").alias("longest"), r6(F.avg("n")).alias("mean_run"))
)


def _loss_runs(df: DataFrame) -> DataFrame:
    from ..operators.align import runs

    return runs(df, F.col("ret_1") < 0, ["symbol"]).where("ret_1 < 0").groupBy("symbol", "run_id").agg(F.count("*").alias("n"))


@register(
    "cost_dynamic",
    f"{FEAT}, m AS (SELECT *, greatest(coalesce(nullif(quote_volume, 0), 1e6), 1.0) AS avail FROM feat), n AS (SELECT *, (1 / avail) / max(1 / avail) OVER (PARTITION BY symbol) AS scale FROM m) "
    f"SELECT symbol, ts, {s6('greatest(0.0, least(150.0, 4.0 + 0.5 * 2.0 + 0.1 * abs(coalesce(bar_range, 0)) + scale + 0.1 * 10 * sqrt(1000.0 / avail)))')} AS cost_bps FROM n",
)
def cost_dynamic(spark: SparkSession, d: str) -> DataFrame:
    avail = F.greatest(F.coalesce(F.nullif(F.col("quote_volume"), F.lit(0.0)), F.lit(1e6)), F.lit(1.0))
    df = feat(spark, d).withColumn("avail", avail)
    scale = (1 / F.col("avail")) / F.max(1 / F.col("avail")).over(Window.partitionBy("symbol"))
    cost = 4.0 + F.lit(0.5) * 2.0 + 0.1 * F.abs(F.coalesce("bar_range", F.lit(0.0))) + scale + F.lit(0.1) * 10 * F.sqrt(F.lit(1000.0) / F.col("avail"))
    return df.select("symbol", "ts", r6(F.greatest(F.lit(0.0), F.least(F.lit(150.0), cost))).alias("cost_bps"))


@register(
    "control_lagged",
    f"{FEAT}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS bar FROM feat) SELECT e.symbol, e.ts, {s6('e.bar_range - c.bar_range')} AS delta FROM b e LEFT JOIN b c ON c.symbol = e.symbol AND c.bar = e.bar - 24 WHERE e.spread_z > 2",
)
def control_lagged(spark: SparkSession, d: str) -> DataFrame:
    return feat(spark, d).withColumn("c", F.lag("bar_range", 24).over(W())).where("spread_z > 2").select("symbol", "ts", r6(F.col("bar_range") - F.col("c")).alias("delta"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
