"""Sources and sinks, conditions on event tables, alignment, and set operations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import first_column, ratio
from ..operators.align import active_on_grid, asof_join, repeated_keys
from ..operators.snapshots import write_incomplete
from ..sources.readers import overlay, parse_liquidations, parse_mark_price, parse_onchain, parse_open_interest, parse_quotes, read_funding, strings, write_months
from . import panel as P
from .more_features import FEAT
from .queries import oracle_sql, queries, r6, register, s6  # noqa: F401


def feat(spark: SparkSession, d: str) -> DataFrame:
    return P.features(P.cleaned(spark, d))


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-lake-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def through_csv(spark: SparkSession, df: DataFrame, name: str, header: bool) -> DataFrame:
    """The rows written as CSV files and read back as text columns."""
    path = shared(spark, name)
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.option("header", str(header).lower()).csv(path)
    return strings(spark, path, df.columns, header)


def millis() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


# --- sources: events written in each raw layout, and read back by its parser ------------------------------


@register("src_mark_price", "SELECT event_type AS symbol, date_trunc('milliseconds', ts) AS ts, value AS mark_price FROM events")
def src_mark_price(spark: SparkSession, d: str) -> DataFrame:
    raw = P.table(spark, d, "events").select(F.col("event_type").alias("symbol"), millis().alias("open_time"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(0).alias("volume"))
    back = through_csv(spark, raw, "mark", False)
    return parse_mark_price(back, F.col("symbol"))


@register("src_quotes", "SELECT event_type AS symbol, date_trunc('milliseconds', ts) AS ts, value - 0.5 AS bid_price, 1.0 AS bid_qty, value + 0.5 AS ask_price, CAST(user_id AS DOUBLE) AS ask_qty FROM events")
def src_quotes(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    raw = P.table(spark, d, "events").select("event_type", (v - 0.5).alias("best_bid_price"), F.lit(1.0).alias("best_bid_qty"), (v + 0.5).alias("best_ask_price"), F.col("user_id").alias("best_ask_qty"), millis().alias("transaction_time"), F.lit(None).cast("long").alias("event_time"))
    return parse_quotes(through_csv(spark, raw, "quotes", True), F.col("event_type"))


@register(
    "src_liquidations",
    "SELECT DISTINCT event_type AS symbol, to_timestamp(CAST(floor(epoch(ts)) AS BIGINT))::TIMESTAMP AS ts, CASE WHEN user_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(user_id AS DOUBLE) AS quantity, value AS price, user_id * value AS notional FROM events",
)
def src_liquidations(spark: SparkSession, d: str) -> DataFrame:
    """Seconds since 1970 here, told from milliseconds by the file's median; a side written in three ways."""
    side = F.when(F.col("user_id") % 4 == 0, " buy").when(F.col("user_id") % 2 == 0, "B").otherwise("Sell")
    raw = P.table(spark, d, "events").select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), side.alias("side"), F.col("value").alias("average_price"), F.col("user_id").alias("accumulated_fill_quantity"))
    return parse_liquidations(through_csv(spark, raw, "liquidations", True), F.col("event_type"))


@register("src_open_interest", "SELECT symbol, ts, open_interest FROM (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, value AS open_interest, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY value DESC) AS k FROM events WHERE value IS NOT NULL) WHERE k = 1")
def src_open_interest(spark: SparkSession, d: str) -> DataFrame:
    raw = P.table(spark, d, "events").select("event_type", F.date_format(F.date_trunc("HOUR", "ts"), "yyyy-MM-dd HH:mm:ss").alias("create_time"), F.col("value").alias("sumOpenInterest"))
    return parse_open_interest(through_csv(spark, raw, "interest", True), F.col("event_type"))


@register("src_onchain", "SELECT CASE event_type WHEN 'click' THEN 'XCLICK' ELSE event_type || 'USDT' END AS symbol, ts, value AS netflow_coin, user_id * 1000.0 AS mcap_usd FROM events")
def src_onchain(spark: SparkSession, d: str) -> DataFrame:
    raw = P.table(spark, d, "events").select(F.col("ts").alias("ts_event"), F.col("event_type").alias("asset"), F.col("value").alias("netflow_coin"), (F.col("user_id") * 1000.0).alias("mcap_usd"))
    return parse_onchain(raw, {"click": "XCLICK"}, "USDT")


@register("src_candidate_dirs", "SELECT event_type, event_id, CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END AS value FROM events WHERE event_id % 3 = 0 OR event_id % 2 = 0")
def src_candidate_dirs(spark: SparkSession, d: str) -> DataFrame:
    """A run's own rows over the shared ones, key by key."""
    e = P.table(spark, d, "events").select("event_type", "event_id", "value")
    own, common = e.where("event_id % 3 = 0").withColumn("value", F.col("value") * 2), e.where("event_id % 2 = 0")
    return overlay(own, common, keys=("event_id",)).select("event_type", "event_id", "value")


@register("src_parquet_tree", "SELECT event_id, event_type, value FROM events")
def src_parquet_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree of Parquet folders of differing columns, read as one table."""
    root, e = shared(spark, "tree"), P.table(spark, d, "events")
    e.where("event_id % 2 = 0").select("event_id", "event_type", "value").write.parquet(f"{root}/a/b")
    e.where("event_id % 2 = 1").select("event_id", "value", "event_type").write.parquet(f"{root}/c")
    return spark.read.option("recursiveFileLookup", "true").parquet(root).select("event_id", "event_type", "value")


@register("src_events_any", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1")
def src_events_any(spark: SparkSession, d: str) -> DataFrame:
    """One table of all events, in a folder per type: the filter on types reads their folders only."""
    path = shared(spark, "by-type")
    P.table(spark, d, "events").write.partitionBy("event_type").parquet(path)
    return spark.read.parquet(path).where(F.col("event_type").isin("error", "signup")).groupBy("event_type").agg(F.count("*").alias("n"))


# --- sinks ---------------------------------------------------------------------------------------------


@register("sink_month_partitions", f"WITH {P.BARS_SQL} SELECT symbol, ts, CASE WHEN symbol = 'error' THEN -close ELSE close END AS close FROM bars")
def sink_month_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Bars by symbol, year and month; writing one symbol again replaces its partitions and no others."""
    path, bars = shared(spark, "months"), P.bars(spark, d).select("symbol", "ts", "close")
    write_months(bars, path)
    write_months(bars.where("symbol = 'error'").withColumn("close", -F.col("close")), path)
    return spark.read.parquet(path).select("symbol", "ts", "close")


@register("sink_skip_complete", f"WITH {P.BARS_SQL} SELECT symbol, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS expected, CASE WHEN day(min(ts)) % 5 = 0 THEN 0 ELSE 2 * count(*) END AS found FROM bars GROUP BY 1, 2 HAVING day(min(ts)) % 5 = 0 OR day(min(ts)) % 7 = 0")
def sink_skip_complete(spark: SparkSession, d: str) -> DataFrame:
    """The partitions that a second run writes, when the first has left some out and written others twice over.

    Which they are is told from the files; a third run finds all complete and adds nothing to the result.
    """
    path, bars = shared(spark, "complete"), P.bars(spark, d).select("symbol", "ts", "close").withColumn("day", F.to_date("ts"))
    write_incomplete(bars.where(F.day("ts") % 5 != 0).unionByName(bars.where((F.day("ts") % 7 == 0) & (F.day("ts") % 5 != 0))), path, ["symbol", "day"])
    again = write_incomplete(bars, path, ["symbol", "day"])
    return again.unionByName(write_incomplete(bars, path, ["symbol", "day"]))


@register(
    "src_funding",
    "SELECT event_type AS symbol, make_timestamp(CAST(floor((round(epoch_ms(ts) / 1000.0) + 14400) / 28800) * 28800 AS BIGINT) * 1000000) AS ts, value / 10000 AS funding_rate FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL",
)
def src_funding(spark: SparkSession, d: str) -> DataFrame:
    """Events written as funding files of five layouts (named or not, seconds or milliseconds), read back in one go."""
    e = P.table(spark, d, "events").where("value is not null and event_type is not null")
    rate = (F.col("value") / 10000).cast("string")
    ms, s = millis().cast("string"), F.round(millis() / 1000).cast("long").cast("string")
    layouts = [
        ("calc_time,funding_interval_hours,last_funding_rate", [ms, F.lit("8"), rate]), ("symbol,fundingTime,fundingRate", [F.lit("x"), ms, rate]), ("funding_rate,timestamp", [rate, s]), (None, [ms, F.lit("8"), rate]), (None, [s, rate]),
    ]
    path = shared(spark, "funding")
    for i, (names, cells) in enumerate(layouts):
        rows = e.where(F.pmod(F.xxhash64("event_type"), F.lit(5)) == i).select("event_type", *[c.alias(n) for c, n in zip(cells, names.split(",") if names else ("a", "b", "c"))])
        rows.write.partitionBy("event_type").option("header", str(bool(names)).lower()).csv(f"{path}/{i}")
    return read_funding(spark, path, F.regexp_extract(F.col("_metadata.file_path"), "event_type=([^/]*)", 1))


@register("sink_replace_event_type", "SELECT event_type, event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value FROM events WHERE event_type <> 'error' OR event_id % 2 = 0")
def sink_replace_event_type(spark: SparkSession, d: str) -> DataFrame:
    """New rows of some types in place of all old ones of these types."""
    e = P.table(spark, d, "events").select("event_type", "event_id", "value")
    new = e.where("event_type = 'error' and event_id % 2 = 0").withColumn("value", F.lit(0.0))
    return e.join(F.broadcast(new.select("event_type").distinct()), "event_type", "left_anti").unionByName(new)


@register("sink_flag_merge", f"WITH {P.CLEANED_SQL}, o AS (SELECT symbol, ts, close > 200 AS flag FROM cleaned WHERE close IS NOT NULL), n AS (SELECT symbol, ts, close > 400 AS flag FROM cleaned WHERE symbol IN ('click', 'view') AND close IS NOT NULL) SELECT symbol, ts, coalesce(n.flag, o.flag) AS flag FROM o FULL JOIN n USING (symbol, ts)")
def sink_flag_merge(spark: SparkSession, d: str) -> DataFrame:
    bars = P.cleaned(spark, d).where("close is not null")
    old = bars.select("symbol", "ts", (F.col("close") > 200).alias("old"))
    new = bars.where("symbol in ('click', 'view')").select("symbol", "ts", (F.col("close") > 400).alias("new"))
    return old.join(new, ["symbol", "ts"], "full").select("symbol", "ts", F.coalesce("new", "old").alias("flag"))


# --- columns and conditions -----------------------------------------------------------------------------

register("coalesce_columns", "SELECT event_id, value AS price FROM events")(lambda spark, d: (lambda e: e.select("event_id", first_column(e, ["mark", "value", "price"]).alias("price")))(P.table(spark, d, "events")))
register("default_missing_columns", "SELECT event_id, value, 0.0 AS spread, 0.0 AS depth FROM events")(lambda spark, d: _defaults(P.table(spark, d, "events").select("event_id", "value"), {"value": 0.0, "spread": 0.0, "depth": 0.0}))


def _defaults(df: DataFrame, wanted: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in wanted.items() if c not in df.columns})


register("cond_session_eu", f"{FEAT} SELECT symbol, ts FROM feat WHERE hour(ts) BETWEEN 8 AND 15")(lambda spark, d: feat(spark, d).where(F.hour("ts").between(8, 15)).select("symbol", "ts"))
register("cond_bucket", f"{FEAT} SELECT symbol, ts, 'symbol_' || symbol AS by_symbol, CASE WHEN trend > 0 THEN 'bull_bear_bull' ELSE 'bull_bear_bear' END AS by_side FROM feat WHERE symbol = 'click' AND coalesce(rv_z > 0, FALSE)")(
    lambda spark, d: feat(spark, d).where((F.col("symbol") == "click") & (F.col("rv_z") > 0)).select("symbol", "ts", F.concat(F.lit("symbol_"), "symbol").alias("by_symbol"), F.when(F.col("trend") > 0, "bull_bear_bull").otherwise("bull_bear_bear").alias("by_side"))
)
_AGE = "(ts_us - max(CASE WHEN spread_z > 1 THEN ts_us END) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) // 3600000000"
register("cond_age_buckets", f"{FEAT}, u AS (SELECT *, epoch_us(ts) AS ts_us FROM feat), a AS (SELECT symbol, ts, {_AGE} AS age FROM u) SELECT symbol, ts, CASE WHEN age <= 8 THEN 'early' WHEN age <= 30 THEN 'mid' WHEN age <= 96 THEN 'late' END AS age_bucket FROM a WHERE age <= 96")(
    lambda spark, d: _ages(feat(spark, d))
)


def _ages(f: DataFrame) -> DataFrame:
    """How many hours ago the last event of the symbol was, in three buckets; older ones are left out."""
    seen = F.last(F.when(F.col("spread_z") > 1, F.col("ts")), ignorenulls=True).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    age = F.timestamp_diff("HOUR", seen, F.col("ts"))
    return f.withColumn("age", age).where("age <= 96").select("symbol", "ts", F.when(F.col("age") <= 8, "early").when(F.col("age") <= 30, "mid").otherwise("late").alias("age_bucket"))


_COMPRESSED = {"alone": "ratio_now <= 0.8", "with_trend": "ratio_now <= 0.8 AND abs_trend > 0.5", "low_funding": "ratio_now <= 0.8 AND funding < 0", "high_funding": "ratio_now <= 0.8 AND funding > 0", "oi_rise": "ratio_now <= 0.8 AND oi_delta > 0"}
_FW = "fw AS (SELECT *, lead(close, 3) OVER w / nullif(close, 0) - 1 AS r3, lead(close, 12) OVER w / nullif(close, 0) - 1 AS r12 FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
register("compression_conditions", f"{FEAT}, {_FW} " + " UNION ALL ".join(f"SELECT '{n}' AS condition_name, {h} AS horizon, count(r{h}) AS n, {s6(f'avg(r{h})')} AS mean, {s6(f'quantile_cont(r{h}, 0.5)')} AS median FROM fw WHERE {c} HAVING count(*) > 0" for n, c in _COMPRESSED.items() for h in (3, 12)))(
    lambda spark, d: _compression(feat(spark, d))
)


def _compression(f: DataFrame) -> DataFrame:
    """All conditions and horizons in one pass over the rows that any of them lets through."""
    tight, w = F.col("ratio_now") <= 0.8, Window.partitionBy("symbol").orderBy("ts")
    conditions = {"alone": tight, "with_trend": tight & (F.col("abs_trend") > 0.5), "low_funding": tight & (F.col("funding") < 0), "high_funding": tight & (F.col("funding") > 0), "oi_rise": tight & (F.col("oi_delta") > 0)}
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), (ratio(F.lead("close", h).over(w), F.col("close")) - 1).alias("r")) for h in (3, 12)])
    each = f.select(names.alias("names"), ahead.alias("ahead")).select(F.explode("names").alias("condition_name"), "ahead").select("condition_name", F.inline("ahead"))
    return each.groupBy("condition_name", "horizon").agg(F.count("r").alias("n"), r6(F.avg("r")).alias("mean"), r6(F.percentile("r", F.lit(0.5))).alias("median"))


# --- alignment ------------------------------------------------------------------------------------------

_FUNDS = "f AS (SELECT event_type AS symbol, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '2024-01-01') AS fts, round(avg(value) * 1e-5, 9) AS rate FROM events WHERE user_id % 3 = 0 GROUP BY 1, 2)"


@register("funding_align", f"WITH {P.CLEANED_SQL}, {_FUNDS}, j AS (SELECT c.symbol, c.ts, f.fts, f.rate FROM cleaned c ASOF LEFT JOIN f ON f.symbol = c.symbol AND c.ts >= f.fts) SELECT symbol, ts, CASE WHEN fts >= ts - INTERVAL 8 HOUR THEN rate END AS rate_feature, CASE WHEN fts = ts THEN rate END AS rate_realized, coalesce(fts < ts - INTERVAL 8 HOUR, TRUE) AS funding_missing FROM j")
def funding_align(spark: SparkSession, d: str) -> DataFrame:
    e = P.table(spark, d, "events").where("user_id % 3 = 0")
    rates = e.groupBy(F.col("event_type").alias("symbol"), F.window("ts", "8 hours").start.cast("timestamp_ntz").alias("ts")).agg(F.round(F.avg("value") * 1e-5, 9).alias("rate"))
    joined = asof_join(P.cleaned(spark, d).select("symbol", "ts"), rates, ["symbol"], tolerance=F.expr("interval 8 hours"))
    return joined.select("symbol", "ts", F.col("rate").alias("rate_feature"), F.when(F.col("matched_ts") == F.col("ts"), F.col("rate")).alias("rate_realized"), F.col("matched_ts").isNull().alias("funding_missing"))


@register("snapshot_grid", f"WITH {P.CLEANED_SQL}, q AS (SELECT event_type AS symbol, ts AS qts, max(value) AS mid FROM events GROUP BY 1, 2), j AS (SELECT c.symbol, c.ts, qts, mid FROM cleaned c ASOF LEFT JOIN q ON q.symbol = c.symbol AND c.ts >= q.qts) SELECT symbol, ts, CASE WHEN qts >= ts - INTERVAL 15 MINUTE THEN mid END AS mid FROM j")
def snapshot_grid(spark: SparkSession, d: str) -> DataFrame:
    """The last quote of at most fifteen minutes' age on every point of the grid."""
    quotes = P.table(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), "ts").agg(F.max("value").alias("mid"))
    return asof_join(P.cleaned(spark, d).select("symbol", "ts"), quotes, ["symbol"], tolerance=F.expr("interval 15 minutes")).select("symbol", "ts", "mid")


@register("eligibility_interval", f"WITH {P.CLEANED_SQL}, l AS (SELECT DISTINCT event_type AS symbol, date_trunc('day', ts) AS a FROM events WHERE user_id % 7 = 0 AND hour(ts) < 2) SELECT c.symbol, c.ts, EXISTS (SELECT 1 FROM l WHERE l.symbol = c.symbol AND c.ts BETWEEN l.a AND l.a + INTERVAL 12 HOUR) AS eligible FROM cleaned c")
def eligibility_interval(spark: SparkSession, d: str) -> DataFrame:
    spans = P.table(spark, d, "events").where((F.col("user_id") % 7 == 0) & (F.hour("ts") < 2)).select(F.col("event_type").alias("symbol"), F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("enter_ts")).distinct()
    spans = spans.withColumn("exit_ts", F.col("enter_ts") + F.expr("interval 12 hours"))
    return active_on_grid(P.cleaned(spark, d).select("symbol", "ts"), spans, ["symbol"]).withColumnRenamed("active", "eligible")


register("join_many_to_one", "SELECT c_custkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT o_custkey, count(*) FROM orders GROUP BY 1 HAVING count(*) > 1")(
    lambda spark, d: repeated_keys(P.table(spark, d, "customer"), ["c_custkey"]).unionByName(repeated_keys(P.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]))
)
register("set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%' INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")(
    lambda spark, d: P.table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("k")).intersect(P.table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")))
)
register("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")(
    lambda spark, d: P.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(P.table(spark, d, "orders").where("o_totalprice > 250000").select("o_custkey").distinct())
)
register("json_props", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda spark, d: P.table(spark, d, "events").groupBy("event_type", (F.from_json("props", "map<string,bigint>")["k"] % 10).alias("k")).agg(F.count("*").alias("n"))
)
_SETS = "s AS (SELECT DISTINCT o_custkey % 40 AS a, o_orderdate::DATE AS x FROM orders), n AS (SELECT a, count(*) AS n FROM s GROUP BY 1), p AS (SELECT p.a AS a, q.a AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.a < q.a GROUP BY 1, 2)"
register("dedupe_jaccard", f"WITH {_SETS} SELECT p.a, b, {s6('c * 1.0 / (m.n + o.n - c)')} AS jaccard FROM p JOIN n m ON m.a = p.a JOIN n o ON o.a = p.b WHERE c * 1.0 / (m.n + o.n - c) >= 0.05")(
    lambda spark, d: _overlaps(P.table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("a"), F.to_date("o_orderdate").alias("x")).distinct())
)


def _overlaps(sets: DataFrame, least: float = 0.05) -> DataFrame:
    """Pairs of candidates by the share of events they have in common, from events that stand in both."""
    n = sets.groupBy("a").agg(F.count("*").alias("n"))
    pairs = sets.join(sets.withColumnRenamed("a", "b"), "x").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    both = pairs.join(F.broadcast(n), "a").join(F.broadcast(n.select(F.col("a").alias("b"), F.col("n").alias("m"))), "b")
    return both.withColumn("j", F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).where(F.col("j") >= least).select("a", "b", r6(F.col("j")).alias("jaccard"))


register("universe_snapshot", "WITH d AS (SELECT date_trunc('month', o_orderdate) AS ts, o_orderpriority AS symbol, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), r AS (SELECT *, avg(v) OVER (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING) AS adv FROM d) SELECT ts, list(symbol ORDER BY symbol) FILTER (WHERE adv > 140000)::VARCHAR AS included, sha256(string_agg(symbol, ',' ORDER BY symbol) FILTER (WHERE adv > 140000)) AS hash FROM r GROUP BY 1 HAVING count(*) FILTER (WHERE adv > 140000) > 0")(
    lambda spark, d: _universe(P.table(spark, d, "orders"))
)


def _universe(orders: DataFrame, least: float = 140000.0) -> DataFrame:
    months = orders.groupBy(F.date_trunc("MONTH", "o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderpriority").alias("symbol")).agg(F.avg("o_totalprice").alias("v"))
    adv = F.avg("v").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-2, 0))
    held = months.withColumn("adv", adv).where(F.col("adv") > least).groupBy("ts").agg(F.array_sort(F.collect_list("symbol")).alias("all"))
    return held.select("ts", F.concat(F.lit("["), F.array_join("all", ", "), F.lit("]")).alias("included"), F.sha2(F.array_join("all", ","), 256).alias("hash"))
