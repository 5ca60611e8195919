"""Numbering rows by a value without sorting a key in one place, and the nearest rows of a pool by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import asof_join
from .spans import rows_within


def numbered_by(df: DataFrame, by: list[str], value: str, tie: str, name: str = "pos", parts: int = 64, tie_parts: int = 16) -> DataFrame:
    """Adds `name`: 1, 2, ... in order of `value`, then `tie` (a whole number), within each key. Rows without a value are left out.

    Approximate quantiles cut a key into parts of about equal size; rows are sorted within a part, and only the parts'
    counts are added up. Rows whose value is itself a cut are a part of their own, cut further by quantiles of `tie`, so
    one value that very many rows share is the work of several tasks. How good the quantiles are has no effect on the result.
    """
    known = df.where(F.col(value).isNotNull())
    shares = lambda n: F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = known.groupBy(*by).agg(F.percentile_approx(value, shares(parts), 20 * parts).alias("_cuts"), F.percentile_approx(tie, shares(tie_parts), 20 * tie_parts).alias("_ties"))
    below = lambda cuts, c: F.size(F.filter(cuts, lambda x: x < c))
    marked = known.join(cuts, by)
    own = F.array_contains("_cuts", F.col(value))
    marked = marked.withColumn("_part", 2 * below("_cuts", F.col(value)) + own.cast("int")).withColumn("_sub", F.when(own, below("_ties", F.col(tie))).otherwise(0))
    # equal cuts count once for the value above them, which keeps the order of the parts
    counts = marked.groupBy(*by, "_part", "_sub").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part", "_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.withColumn("_before", before).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_part", "_sub").orderBy(value, tie))
    return marked.join(sums, [*by, "_part", "_sub"]).withColumn(name, (F.col("_before") + inside).cast("long")).drop("_part", "_sub", "_before", "_cuts", "_ties")


def nearest(events: DataFrame, pool: DataFrame, by: list[str], value: str, event: str, control: str, k: int = 200, block: float | None = None) -> DataFrame:
    """(by, event, control, distance, near): the `k` rows of the pool whose value is nearest each event's, numbered from 1.

    Of equal distances those below come first, then those that stand nearer in the pool's order (by value, then `control`,
    a whole number). `event` and `control` are unique within a key; events and pool rows without a value are left out. The
    two sides meet in the order of the pool: an event's place in it is found by an as-of join, and it is compared with
    the k rows on either side alone.
    """
    placed = numbered_by(pool.select(*by, value, control), by, value, control, "_pos")
    ends = asof_join(events.where(F.col(value).isNotNull()).select(*by, value, event), placed.groupBy(*by, value).agg(F.max("_pos").alias("_pos")), by, on=value, columns=["_pos"], right_time="_at", block=block)
    spans = ends.select(*by, event, F.col(value).alias("_value"), F.coalesce("_pos", F.lit(0)).alias("_place")).withColumns({"_first": F.col("_place") - (k - 1), "_last": F.col("_place") + k})
    near = rows_within(placed.select(*by, "_pos", F.col(value).alias("_other"), control), spans, by, "_pos", "_first", "_last", bucket=max(128, k))
    distance = F.abs(F.col("_value") - F.col("_other"))
    order = Window.partitionBy(*by, event).orderBy(distance, F.col("_pos") > F.col("_place"), F.abs(F.col("_pos") - F.col("_place")))
    return near.select(*by, event, control, distance.alias("distance"), F.row_number().over(order).alias("near")).where(F.col("near") <= k)


def drawn(near: DataFrame, by: list[str], event: str, draws: int, mixed: Column) -> DataFrame:
    """`draws` of each event's rows, without one twice, by the smallest values of `mixed` (a hash of event and row)."""
    order = Window.partitionBy(*by, event).orderBy(mixed)
    return near.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= draws)
