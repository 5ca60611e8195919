"""Where each member stands among all at one time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cross_section(df: DataFrame, by: list[str], value: str, least: int = 3, eps: float = 1e-12) -> DataFrame:
    """Adds to the rows of each `by` (a time) n, cs_mean, cs_std, cs_median, cs_mad, cs_z, cs_robust_z and cs_rank of `value`.

    Rows whose value is null, NaN or infinite are left out, and times with fewer than `least` others. The robust score is the
    distance from the median in 1.4826 median absolute deviations; both scores take `eps` more than the spread, so equal values
    score 0. The rank is dense, over n. One shuffle by `by`; null keys are keys, an empty table gives no rows.
    """
    x = F.col(value).cast("double")
    at = Window.partitionBy(*by)
    half = F.lit(0.5)
    rows = df.withColumn("_x", x).where(~F.isnan("_x") & (F.abs("_x") < float("inf")))
    rows = rows.withColumns({"n": F.count("*").over(at), "cs_mean": F.avg("_x").over(at), "cs_std": F.coalesce(F.stddev_samp("_x").over(at), F.lit(0.0)), "cs_median": F.percentile("_x", half).over(at), "cs_rank": F.dense_rank().over(at.orderBy("_x"))})
    rows = rows.where(F.col("n") >= least).withColumn("cs_mad", F.percentile(F.abs(F.col("_x") - F.col("cs_median")), half).over(at))
    return rows.withColumns(
        {"cs_z": (F.col("_x") - F.col("cs_mean")) / (F.col("cs_std") + eps), "cs_robust_z": (F.col("_x") - F.col("cs_median")) / (1.4826 * F.col("cs_mad") + eps), "cs_rank": F.col("cs_rank") / F.col("n")}
    ).drop("_x")


def momentum(df: DataFrame, keys: list[str], time: str, value: str, rows: int, least: int = 3) -> DataFrame:
    """(keys, time, ret, score): the log of `value` against `rows` rows before, and 2 * rank - 1 of it among all at its time.

    Rows without a positive value now or then have no return and no row.
    """
    before = F.lag(value, rows).over(Window.partitionBy(*keys).orderBy(time))
    ret = F.when((F.col(value) > 0) & (before > 0), F.log(F.col(value) / before))
    ranked = cross_section(df.select(*keys, time, ret.alias("ret")), [time], "ret", least)
    return ranked.select(*keys, time, "ret", (2 * F.col("cs_rank") - 1).alias("score"))
