"""Bars, quote aggregates, cool-down and de-duplication on streams, with watermarks for late rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, table: str = "events.parquet") -> DataFrame:
    """A table of a folder as a stream of files, be it one file or a folder of part files."""
    path = f"{folder}/{table}"
    known = spark.read.parquet(path).schema
    source = spark.readStream.schema(known)
    if any(f.rstrip("/").endswith(f"/{table}") for f in spark.read.parquet(path).inputFiles()[:1]):
        rows = source.option("pathGlobFilter", table).parquet(folder)
    else:
        rows = source.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(events: DataFrame, step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Closed bars; a bar is sent when the watermark has passed its end."""
    order = F.struct("ts", "event_id")
    bars = events.withWatermark("ts", late).groupBy(F.window("ts", step), F.col("event_type").alias("symbol"))
    return bars.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume")).select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_dedupe(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stream_quotes(quotes: DataFrame, step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Closed aggregates of quotes (symbol, ts, spread_bps, depth), sent as stream_bars sends bars."""
    groups = quotes.withWatermark("ts", late).groupBy(F.window("ts", step), "symbol")
    sums = groups.agg(F.count("*").alias("n"), F.avg("spread_bps").alias("spread_mean"), F.max("spread_bps").alias("spread_max"), F.avg("depth").alias("depth_mean"), F.min("depth").alias("depth_min"))
    return sums.select("symbol", F.col("window.start").alias("ts"), "n", "spread_mean", "spread_max", "depth_mean", "depth_min")


def stream_cooldown(events: DataFrame, by: str, gap: pd.Timedelta, late: str = "10 minutes") -> DataFrame:
    """(by, ts, event_id) of the events that lie `gap` or more after the last one kept of their key; of equal times the smallest id.

    A key's state is the time last kept. It goes by a timer once the watermark, `late` behind the latest event, has passed
    the end of its gap, so keys that have fallen silent take no memory. Rows behind the watermark, or behind the last kept
    time, are late and go. Rows of one trigger are sorted; they are held at once, so limit its files (maxFilesPerTrigger)
    where a key is crowded.
    """
    wait = gap.value // 1000

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        behind = state.getCurrentWatermarkMs() * 1000
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        rows = rows[rows["ts"].astype("datetime64[us]").astype("int64") >= behind].reset_index(drop=True)
        times, kept = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy(), []
        last = state.get[0] if state.exists else None
        place = 0 if last is None else int(np.searchsorted(times, last + wait))
        while place < len(times):
            kept.append(place)
            last = int(times[place])
            place = int(np.searchsorted(times, last + wait))
        if kept:
            state.update((last,))
        if last is not None:
            state.setTimeoutTimestamp(max((last + wait) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield rows.loc[kept, [by, "ts", "event_id"]]

    rows = events.select(by, "ts", "event_id").where(F.col("ts").isNotNull()).withWatermark("ts", late)
    return rows.groupBy(by).applyInPandasWithState(keep, rows.schema, "last long", "append", "EventTimeTimeout")
