"""Multiple-testing adjustment with window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bh_adjust(df: DataFrame, p: str, q: str, by: list[str]) -> DataFrame:
    """Adds Benjamini-Hochberg q-values within each group; equal p-values share their highest rank."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    at_most = F.count("*").over(w.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    raised = df.withColumn("_raised", F.col(p) * F.count("*").over(w) / at_most)
    best = F.min("_raised").over(w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0))
    return raised.withColumn(q, F.least(F.lit(1.0), best)).drop("_raised")


def simes(df: DataFrame, p: str, by: list[str], out: str = "simes_p") -> DataFrame:
    """One Simes p-value per group."""
    w = Window.partitionBy(*by)
    ranked = df.withColumns({"_k": F.row_number().over(w.orderBy(p)), "_m": F.count("*").over(w)})
    return ranked.groupBy(*by).agg(F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_k"))).alias(out))
