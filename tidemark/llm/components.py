"""Connected components of a link table, by alternating large and small stars on DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read back, so that no lost executor can take it along.

    The folder is the session's spark.checkpoint.dir; only where that is unset (as in tests) a temporary one.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Without one a local session gets a temporary folder; on a cluster,
    where a folder of one machine would not do, that is an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (u long, v long); root is the smallest node it reaches.

    Every round hangs each node's neighbours on its smallest one, first the larger then the smaller
    neighbours, so trees flatten in about log(diameter) rounds. Minima are pre-aggregated and joined back,
    those of nodes with very many links by broadcast, so such a node is no single task's work. Loops and
    repeated links are ignored.
    """
    edges = durable(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = settled(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = join_by_key(both.where("v > u"), least, "u", "n", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_by_key(large, least, "u", "n", 2 * state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = settled(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def settled(edges: DataFrame) -> tuple:
    """Number and checksum of the links: equal after a round that changes nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
