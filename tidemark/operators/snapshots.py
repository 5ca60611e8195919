"""Tables that grow from run to run: pooling strengths smoothed against the run before, and partitions written once."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def adaptive_lambda(
    units: DataFrame,
    parent: list[str],
    previous: DataFrame | None = None,
    low: float = 5.0,
    high: float = 5000.0,
    least: float = 200.0,
    alpha: float = 0.1,
    cap: float = 0.5,
    eps: float = 1e-8,
) -> DataFrame:
    """(parent, lambda, raw, prev, status, sigma_within, sigma_between, total_n, children): how strongly a parent pools its units.

    `units` has one row a unit: the parent's columns, n, mean, var; nulls count as 0, negative n and var too. Lambda is the
    ratio of the variance within units to that between their means, within [low, high]. Statuses: `insufficient_data` (under
    `least` observations: 0, no pooling), `single_child` (one unit with observations, or none: `high`), `adaptive`, and
    `adaptive_smoothed` where `previous` (parent, lambda) holds a positive value: `alpha` of the way from it, and no further
    from it than the share `cap`. Null parents are a parent. An empty table gives no rows.
    """
    at_least_0 = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    u = units.select(*parent, at_least_0("n").alias("_n"), F.coalesce(F.col("mean").cast("double"), F.lit(0.0)).alias("_m"), at_least_0("var").alias("_v"))
    own = Window.partitionBy(*parent)
    centre = F.sum(F.col("_n") * F.col("_m")).over(own) / F.greatest(F.sum("_n").over(own), F.lit(1.0))
    u = u.withColumn("_d", F.col("_n") * (F.col("_m") - centre) ** 2).withColumn("_w", F.greatest(F.col("_n") - 1, F.lit(0.0)))
    g = u.groupBy(*parent).agg(
        F.sum("_n").alias("total_n"), F.count_if(F.col("_n") > 0).alias("children"), (F.sum(F.col("_w") * F.col("_v")) / F.greatest(F.sum("_w"), F.lit(1.0))).alias("_in"), (F.sum("_d") / F.greatest(F.sum("_n"), F.lit(1.0))).alias("_out")
    )
    few, single = F.col("total_n") < least, F.col("children") <= 1
    g = g.withColumns(
        {
            "status": F.when(few, "insufficient_data").when(single, "single_child").otherwise("adaptive"),
            "raw": F.when(few, 0.0).when(single, high).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.col("_in") / F.greatest(F.col("_out"), F.lit(eps))))),
            "sigma_within": F.when(~few, F.col("_in")),
            "sigma_between": F.when(~few, F.when(single, 0.0).otherwise(F.col("_out"))),
        }
    )
    if previous is None:
        g = g.withColumn("prev", F.lit(None).cast("double"))
    else:
        was = previous.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(parent)], F.col("lambda").alias("_prev"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(parent)])
        g = g.join(was, same, "left").withColumn("prev", F.when((F.col("status") == "adaptive") & (F.col("_prev") > 0), F.col("_prev")))
    drawn = (1 - alpha) * F.col("prev") + alpha * F.col("raw")
    smooth = F.greatest(F.col("prev") * (1 - cap), F.least(F.col("prev") * (1 + cap), drawn))
    return g.select(
        *parent, F.when(F.col("prev").isNull(), F.col("raw")).otherwise(smooth).alias("lambda"), "raw", "prev", F.when(F.col("prev").isNull(), F.col("status")).otherwise("adaptive_smoothed").alias("status"), "sigma_within", "sigma_between", "total_n", "children"
    )


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_snapshot(lambdas: DataFrame, path: str, level: str, run: int) -> None:
    """Adds a run's lambdas of one level to the table at `path`; writing the same run again replaces it."""
    rows = lambdas.withColumns({"level": F.lit(level), "run": F.lit(run)})
    rows.write.partitionBy("level", "run").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def latest_snapshot(spark: SparkSession, path: str, level: str, before: int) -> DataFrame | None:
    """The lambdas of a level as the last run before `before` left them; what that run did not hold is not known."""
    if (table := stored(spark, path)) is None:
        return None
    own = table.where((F.col("level") == level) & (F.col("run") < before))
    last = own.agg(F.max("run")).first()[0]
    return None if last is None else own.where(F.col("run") == last).drop("level", "run")


def write_incomplete(df: DataFrame, path: str, partition: list[str], time: str = "ts") -> DataFrame:
    """Writes the partitions of `df` that the files at `path` do not hold in full, and returns them, as they were before.

    A stored partition is complete if it has as many rows as `df` has for it and no time stands twice in it. Complete ones
    are neither written nor touched. The result has the partition's columns, expected and found (0: nothing was there).
    """
    spark = df.sparkSession
    expected = df.groupBy(*partition).agg(F.count("*").alias("expected"))
    held = stored(spark, path)
    if held is None:
        missing = expected.withColumn("found", F.lit(0).cast("long"))
    else:
        kinds = dict(df.dtypes)
        there = held.select(*[F.col(c).cast(kinds[c]).alias(c) for c in partition], F.col(time).alias("_time")).groupBy(*partition).agg(F.count("*").alias("found"), F.count_distinct("_time").alias("_times"))
        both = expected.join(there, partition, "left")
        fine = F.coalesce((F.col("found") == F.col("expected")) & (F.col("_times") == F.col("found")), F.lit(False))
        missing = both.where(~fine).select(*partition, "expected", F.coalesce("found", F.lit(0)).alias("found"))
    # kept by value: the files change below
    told = spark.createDataFrame(missing.collect(), missing.schema)
    if not told.isEmpty():
        df.join(told.select(*partition), partition, "left_semi").write.partitionBy(*partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return told


def monthly_membership(spans: DataFrame, key: str, first: str, last: str, active_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(key, first, last, active) and (month, key): who is listed in which month.

    A key is active if its last time is within `active_days` of the latest of all, and a member of every month from its
    first to its last.
    """
    ends = spans.groupBy(key).agg(F.min(first).alias("first_ts"), F.max(last).alias("last_ts"))
    latest = ends.agg(F.max("last_ts").alias("_z"))  # one row
    listed = ends.join(F.broadcast(latest)).select(key, "first_ts", "last_ts", (F.col("last_ts") >= F.col("_z") - F.expr(f"interval {active_days} days")).alias("active"))
    month = lambda c: F.trunc(c, "MONTH")
    return listed, ends.select(F.explode(F.sequence(month("first_ts"), month("last_ts"), F.expr("interval 1 month"))).alias("month"), key)


def merge_edges(registry: DataFrame | None, observed: DataFrame) -> DataFrame:
    """The observations of all runs, (edge_id, run, cand, effect, promoted); of repeated (edge_id, run, cand) the new one counts."""
    keys = ["edge_id", "run", "cand"]
    if registry is None:
        return observed.dropDuplicates(keys)
    return registry.join(observed.select(*keys), keys, "left_anti").unionByName(observed.dropDuplicates(keys))


def edge_summary(observations: DataFrame) -> DataFrame:
    """(edge_id, first_run, last_run, cand, tested, promoted, median_effect, decay): decay is the slope of the effects along their
    number, in order of runs and candidates; 0 with fewer than two. Effects that are null or no number are left out of both."""
    effect = F.when(~F.isnan("effect") & (F.abs("effect") < F.lit(float("inf"))), F.col("effect"))
    o = observations.withColumn("_x", effect)
    numbered = o.withColumn("_k", F.when(F.col("_x").isNotNull(), F.count("_x").over(Window.partitionBy("edge_id").orderBy("run", "cand").rowsBetween(Window.unboundedPreceding, 0)).cast("double")))
    return numbered.groupBy("edge_id").agg(
        F.min("run").alias("first_run"), F.max("run").alias("last_run"), F.max_by("cand", F.struct("run", "cand")).alias("cand"), F.count("*").alias("tested"), F.count_if("promoted").alias("promoted"),
        F.coalesce(F.percentile("_x", F.lit(0.5)), F.lit(0.0)).alias("median_effect"), F.coalesce(F.when(F.count("_x") > 1, F.regr_slope("_x", "_k")), F.lit(0.0)).alias("decay"),
    )
