"""Profit by market regime."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import durable


def regime_performance(df: DataFrame, by: list[str], time: str, profit: str, days: int = 30) -> DataFrame:
    """(by, n, total, mean, sd, sharpe, max_drawdown) of the profit of each group, for instance of a symbol in a regime.

    The drawdown is the largest fall of the running sum from its highest value so far, in order of time (one row a time and group), nulls
    left out. Sums run within spans of `days`; each span is reduced to its sum, the ends of its range and its own largest fall, and
    only these are chained. Sharpe is mean over deviation, 0 without one. Null keys are keys; rows without a time or profit count nowhere.
    """
    rows = df.where(F.col(profit).isNotNull() & F.col(time).isNotNull()).select(*by, time, F.col(profit).cast("double").alias("_x"), F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (days * 86_400_000_000)).alias("_span"))
    along = Window.partitionBy(*by, "_span").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("_cum", F.sum("_x").over(along)).withColumn("_fall", F.max("_cum").over(along) - F.col("_cum"))
    spans = durable(runs.groupBy(*by, "_span").agg(F.count("*").alias("_n"), F.sum("_x").alias("_sum"), F.avg("_x").alias("_mean"), F.coalesce(F.var_pop("_x"), F.lit(0.0)).alias("_var"), F.max("_cum").alias("_high"), F.min("_cum").alias("_low"), F.max("_fall").alias("_fall")))
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_begin", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    spans = spans.withColumn("_top", F.max(F.col("_begin") + F.col("_high")).over(before))
    spans = spans.withColumn("_centre", F.sum(F.col("_n") * F.col("_mean")).over(Window.partitionBy(*by)) / F.sum("_n").over(Window.partitionBy(*by)))
    n = F.sum("_n")
    sd = F.sqrt(F.sum(F.col("_n") * (F.col("_var") + (F.col("_mean") - F.col("_centre")) ** 2)) / F.nullif(n - 1, F.lit(0)))
    out = spans.groupBy(*by).agg(n.alias("n"), F.sum("_sum").alias("total"), (F.sum("_sum") / n).alias("mean"), sd.alias("sd"), F.max(F.greatest("_fall", F.col("_top") - (F.col("_begin") + F.col("_low")))).alias("max_drawdown"))
    return out.select(*by, "n", "total", "mean", "sd", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).otherwise(0.0).alias("sharpe"), "max_drawdown")


def volatility_segments(df: DataFrame, by: list[str], profit: str, volatility: str, low: float = 0.25, high: float = 0.75, bars_a_year: float = 105_120.0) -> DataFrame:
    """(by, high, mid, low, share_high): the yearly mean profit of each group's bars of high, middle and low volatility.

    Bars at or beyond the quantiles are high or low, and both where these are equal; a part without bars earns 0. Rows without profit or volatility are left out.
    """
    rows = df.where(F.col(profit).isNotNull() & F.col(volatility).isNotNull()).select(*by, F.col(profit).cast("double").alias("_x"), F.col(volatility).cast("double").alias("_v"))
    ends = rows.groupBy(*by).agg(F.percentile("_v", F.lit(high)).alias("_high"), F.percentile("_v", F.lit(low)).alias("_low")).select(*[F.col(c).alias(f"_e{i}") for i, c in enumerate(by)], "_high", "_low")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_e{i}"))
    up, down = F.col("_v") >= F.col("_high"), F.col("_v") <= F.col("_low")
    mean = lambda on: F.coalesce(F.avg(F.when(on, F.col("_x"))), F.lit(0.0)) * bars_a_year
    return rows.join(ends, same).groupBy(*by).agg(mean(up).alias("high"), mean(~up & ~down).alias("mid"), mean(down).alias("low"), (F.count_if(up) / F.count("*")).alias("share_high"))
