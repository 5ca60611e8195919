"""Hierarchical pooling of effects, costs and profit series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pool(df: DataFrame, levels: list[list[str]], effect: str = "effect", sd: str = "sd", n: str = "n", least: int = 200, low: float = 5.0, high: float = 5000.0) -> DataFrame:
    """Shrinks each row's effect towards its parents', level by level.

    `levels` are key lists from the coarsest to the finest; the row itself is the last level. The units of a parent are
    the next level's groups, with the moments of unit_moments: variance within their rows plus between them. A unit's
    weight is n / (n + lambda) with lambda the ratio of the pooled variance of the units to that between their means; a
    parent with one unit takes the highest lambda, one with under `least` observations is not trusted to shrink
    (weight 1). Units count where they have observations, equal effects or not. Adds `pooled`, `weight` and `lambda`.
    Window aggregates take the place of joins; each row adds its share, so a unit's figures are summed over rows.
    """
    top = Window.partitionBy(*levels[0])
    df = df.withColumn("pooled", F.sum(F.col(n) * F.col(effect)).over(top) / F.sum(n).over(top))
    for above, here in zip(levels, [*levels[1:], None], strict=True):
        up = Window.partitionBy(*above)
        if here:
            own = Window.partitionBy(*here)
            df = df.withColumns({"_n": F.sum(n).over(own), "_m": F.sum(F.col(n) * F.col(effect)).over(own) / F.sum(n).over(own), "_rows": F.count("*").over(own)})
            squares = F.sum((F.col(n) - 1) * F.coalesce(F.col(sd), F.lit(0.0)) ** 2 + F.col(n) * (F.col(effect) - F.col("_m")) ** 2).over(own)
            df = df.withColumn("_v", squares / F.greatest(F.col("_n") - 1, F.lit(1)))
        else:
            df = df.withColumns({"_n": F.col(n), "_m": F.col(effect), "_rows": F.lit(1), "_v": F.coalesce(F.col(sd), F.lit(0.0)) ** 2})
        df = df.withColumn("_c", F.sum(F.col(n) * F.col(effect)).over(up) / F.sum(n).over(up))
        within = F.sum((F.col("_n") - 1) * F.col("_v") / F.col("_rows")).over(up) / F.greatest(F.sum((F.col("_n") - 1) / F.col("_rows")).over(up), F.lit(1.0))
        between = F.sum(F.col(n) * (F.col("_m") - F.col("_c")) ** 2).over(up) / F.sum(n).over(up)
        units = F.round(F.sum(F.when(F.col("_n") > 0, 1.0 / F.col("_rows"))).over(up))
        ratio = F.greatest(F.lit(low), F.least(F.lit(high), within / F.greatest(between, F.lit(1e-8))))
        df = df.withColumn("lambda", F.when(F.sum(n).over(up) < least, F.lit(0.0)).when(units <= 1, F.lit(high)).otherwise(ratio))
        df = df.withColumn("weight", F.col("_n") / (F.col("_n") + F.col("lambda"))).withColumn("pooled", F.col("weight") * F.col("_m") + (1 - F.col("weight")) * F.col("pooled"))
    return df.drop("_n", "_m", "_c", "_v", "_rows")


def unit_moments(df: DataFrame, by: list[str], effect: str = "effect", sd: str = "sd", n: str = "n") -> DataFrame:
    """(by, n, mean, var) of each unit: the weighted mean, and the variance within its rows plus that between their means."""
    centre = F.sum(F.col(n) * F.col(effect)).over(Window.partitionBy(*by)) / F.sum(n).over(Window.partitionBy(*by))
    df = df.withColumn("_mu", centre)
    squares = F.sum((F.col(n) - 1) * F.coalesce(F.col(sd), F.lit(0.0)) ** 2) + F.sum(F.col(n) * (F.col(effect) - F.col("_mu")) ** 2)
    return df.groupBy(*by).agg(F.sum(n).alias("n"), F.first("_mu").alias("mean"), (squares / F.greatest(F.sum(n) - 1, F.lit(1))).alias("var"))


def static_cost(fee: Column, slip: Column, cap: float = 150.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(cap), fee + slip))


def profit_parts(position: Column, ret: Column, gap: Column, cost_bps: Column, funding: Column, by: Window) -> dict[str, Column]:
    """Gross profit on the position held before, turnover cost and funding; all 0 in gaps."""
    before = F.coalesce(F.lag(position).over(by), F.lit(0.0))
    on = lambda c: F.when(gap, F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))
    gross, cost, carry = on(before * ret), on(F.abs(position - before) * cost_bps / 10_000), on(-before * funding)
    return {"gross_pnl": gross, "trading_cost": cost, "funding_pnl": carry, "pnl": gross - cost + carry}


def newey_west(df: DataFrame, by: list[str], value: str, order: str, lags: int | None = None) -> DataFrame:
    """(n, mean, t_hac) of each group's series, with Bartlett weights over `lags` lags (default: floor(4 (n / 100)^(2/9)) of the group).

    With the default the longest group's length is counted first, as it decides how many lags the plan holds.
    """
    w = Window.partitionBy(*by)
    auto = F.floor(4 * F.pow(F.count(value).over(w) / 100.0, F.lit(2 / 9)))
    if lags is None:
        longest = df.where(F.col(value).isNotNull()).groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        most = int(4 * (longest / 100) ** (2 / 9) + 1e-9)
    else:
        most = lags
    r = df.withColumns({"_r": F.col(value) - F.avg(value).over(w), "_L": auto if lags is None else F.lit(lags)})
    r = r.withColumns({f"_l{k}": F.lag("_r", k).over(w.orderBy(order)) for k in range(1, most + 1)})
    n = F.count(value)
    part = lambda k: F.sum(F.when(F.lit(k) <= F.col("_L"), 2 * (1 - k / (F.col("_L") + 1)) * F.col("_r") * F.col(f"_l{k}"))) / n
    lrv = F.sum(F.col("_r") * F.col("_r")) / n + sum((F.coalesce(part(k), F.lit(0.0)) for k in range(1, most + 1)), F.lit(0.0))
    return r.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), lrv.alias("_v")).withColumn("t_hac", F.col("mean") / F.sqrt(F.greatest(F.col("_v"), F.lit(1e-18)) / F.col("n"))).drop("_v")
