"""State that one run leaves to the next: pooling strengths, edges, and who is listed when."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshots import adaptive_lambda, edge_summary, latest_snapshot, merge_edges, monthly_membership, stored, write_snapshot
from . import panel as P
from .lake import shared
from .queries import oracle_sql, queries, r6, register, s6  # noqa: F401

#: A run is two years of shipments; a return flag pools its units, of which there are seven by supplier.
_UNITS = "u AS (SELECT year(l_shipdate) // 2 AS run, l_returnflag AS flag, l_suppkey % 7 AS unit, count(*) AS n, avg(l_discount) AS m, coalesce(var_samp(l_discount), 0) AS v FROM lineitem GROUP BY 1, 2, 3)"


@register(
    "lambda_snapshots",
    f"""WITH RECURSIVE {_UNITS}, c AS (SELECT run, flag, sum(n) AS total, count(*) AS children, sum(n * m) / sum(n) AS g FROM u GROUP BY 1, 2),
 s AS (SELECT u.run, u.flag, any_value(total) AS total_n, any_value(children) AS children, sum((n - 1) * v) / greatest(sum(n - 1), 1) AS w, sum(n * (m - g) * (m - g)) / any_value(total) AS b FROM u JOIN c USING (run, flag) GROUP BY 1, 2),
 l AS (SELECT *, CASE WHEN total_n < 200 THEN 'insufficient_data' WHEN children <= 1 THEN 'single_child' ELSE 'adaptive' END AS status, CASE WHEN total_n < 200 THEN 0 WHEN children <= 1 THEN 5000 ELSE greatest(5, least(5000, w / greatest(b, 1e-8))) END AS raw FROM s),
 runs AS (SELECT run, row_number() OVER (ORDER BY run) AS k FROM (SELECT DISTINCT run FROM u)), k AS (SELECT l.*, k, EXISTS (SELECT 1 FROM l p JOIN runs q USING (run) WHERE p.flag = l.flag AND q.k = runs.k - 1) AS known FROM l JOIN runs USING (run)),
 f AS (SELECT flag, k, run, raw, CAST(NULL AS DOUBLE) AS prev, CAST(raw AS DOUBLE) AS lam, status, total_n, children FROM k WHERE NOT known
  UNION ALL SELECT k.flag, k.k, k.run, k.raw, CASE WHEN k.status = 'adaptive' AND f.lam > 0 THEN f.lam END, CASE WHEN k.status = 'adaptive' AND f.lam > 0 THEN greatest(0.5 * f.lam, least(1.5 * f.lam, 0.9 * f.lam + 0.1 * k.raw)) ELSE k.raw END, CASE WHEN k.status = 'adaptive' AND f.lam > 0 THEN 'adaptive_smoothed' ELSE k.status END, k.total_n, k.children FROM f JOIN k ON k.flag = f.flag AND k.k = f.k + 1)
 SELECT flag, CAST(run AS BIGINT) AS run, {s6('lam')} AS lambda, {s6('raw')} AS raw, {s6('prev')} AS prev, status, CAST(total_n AS DOUBLE) AS total_n, children FROM f""",
)
def lambda_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Each run's pooling strength, drawn towards what the run before wrote down; the files of all runs at the end.

    Runs follow each other, as one reads what the last has written; their number is that of the years, not of the rows.
    """
    path, line = shared(spark, "lambdas"), P.table(spark, d, "lineitem").withColumn("run", F.floor(F.year("l_shipdate") / 2))
    for run in [r["run"] for r in line.select("run").distinct().orderBy("run").collect()]:
        units = line.where(F.col("run") == run).groupBy(F.col("l_returnflag").alias("flag"), (F.col("l_suppkey") % 7).alias("unit")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("mean"), F.var_samp("l_discount").alias("var"))
        write_snapshot(adaptive_lambda(units, ["flag"], latest_snapshot(spark, path, "family", run)), path, "family", run)
    if (table := stored(spark, path)) is None:
        return spark.createDataFrame([], "flag string, run long, lambda double, raw double, prev double, status string, total_n double, children long")
    return table.select("flag", F.col("run").cast("long").alias("run"), *[r6(F.col(c)).alias(c) for c in ("lambda", "raw", "prev")], "status", "total_n", "children")


_OBSERVED = "o AS (SELECT sha256(l_returnflag || '|' || l_linestatus || '|' || CAST(l_partkey % 3 AS VARCHAR)) AS edge_id, CAST(year(l_shipdate) AS BIGINT) AS run, CAST(l_suppkey % 5 AS BIGINT) AS cand, round(avg(l_discount), 9) AS effect, avg(l_discount) > 0.05 AS promoted FROM lineitem GROUP BY 1, 2, 3)"


@register(
    "edge_registry_runs",
    f"""WITH {_OBSERVED}, k AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY run, cand) AS k FROM o)
 SELECT edge_id, min(run) AS first_run, max(run) AS last_run, arg_max(cand, run * 10 + cand) AS cand, count(*) AS tested, count(*) FILTER (WHERE promoted) AS promoted, {s6('median(effect)')} AS median_effect, round(coalesce(regr_slope(effect, k), 0), 9) + 0.0 AS decay FROM k GROUP BY 1""",
)
def edge_registry_runs(spark: SparkSession, d: str) -> DataFrame:
    """Edges over three runs of the registry: each merges the years that are new to it into what is stored, and the last one
    brings a year again."""
    line = P.table(spark, d, "lineitem")
    edge = F.sha2(F.concat_ws("|", "l_returnflag", "l_linestatus", (F.col("l_partkey") % 3).cast("string")), 256)
    mean = F.avg("l_discount")
    all_ = line.groupBy(edge.alias("edge_id"), F.year("l_shipdate").cast("long").alias("run"), (F.col("l_suppkey") % 5).cast("long").alias("cand")).agg(F.round(mean, 9).alias("effect"), (mean > 0.05).alias("promoted"))
    path, registry = shared(spark, "edges"), None
    for i, part in enumerate(("run < 1994", "run >= 1994 and run < 1996", "run >= 1995")):
        merge_edges(registry, all_.where(part)).write.parquet(f"{path}/{i}")
        registry = spark.read.schema(all_.schema).parquet(f"{path}/{i}")
    return edge_summary(registry).withColumns({"median_effect": r6(F.col("median_effect")), "decay": F.round("decay", 9)})


@register(
    "listing_membership",
    "WITH e AS (SELECT l_suppkey AS key, CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS z FROM lineitem GROUP BY 1), m AS (SELECT key, CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH)) AS DATE) AS month FROM e) SELECT month, count(*) AS members, count(*) FILTER (WHERE z >= (SELECT max(z) FROM e) - INTERVAL 30 DAY) AS active FROM m JOIN e USING (key) GROUP BY 1",
)
def listing_membership(spark: SparkSession, d: str) -> DataFrame:
    """How many suppliers are listed in each month, and how many of these still are."""
    spans = P.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.to_date("l_shipdate").alias("day"))
    listed, members = monthly_membership(spans, "key", "day", "day", 30)
    return members.join(listed, "key").groupBy("month").agg(F.count("*").alias("members"), F.count_if("active").alias("active"))
