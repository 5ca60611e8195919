"""Raw CSV layouts as string tables, typed without failing on bad rows.

Each reader has a parsing half that works on any DataFrame of strings, so that it can run on files, on
streams and on other tables alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The exchange's column order of a kline file, and the header names of the other layouts below.
KLINE = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_count", "taker_base_volume", "taker_quote_volume", "ignore"]


def strings(spark: SparkSession, path: str, names: list[str], header: bool = False) -> DataFrame:
    """CSV files as text columns of the given names; `header` says whether each file begins with a line of names."""
    return spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", str(header).lower()).csv(path)


def number(c: str | Column) -> Column:
    """A double, null where the text is none or NaN."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def from_epoch(c: Column, millis: Column) -> Column:
    return F.when(millis, F.timestamp_millis(c.cast("long"))).otherwise(F.timestamp_seconds(c)).cast("timestamp_ntz")


def first_number(df: DataFrame, names: list[str]) -> Column:
    """The first column of `names` that exists and holds a number, row by row."""
    found = [number(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def parse_klines(raw: DataFrame, symbol: Column) -> DataFrame:
    """Bars from kline rows; a header row and rows without a time or a price are dropped."""
    prices = ["open", "high", "low", "close", "volume"]
    df = raw.select(symbol.alias("symbol"), number("open_time").alias("_t"), *[number(c).alias(c) for c in [*prices, "quote_volume", "taker_base_volume"]])
    return df.dropna(subset=["_t", *prices]).select("symbol", from_epoch(F.col("_t"), F.lit(True)).alias("ts"), *prices, "quote_volume", "taker_base_volume")


def parse_funding(raw: DataFrame, symbol: Column, file: Column) -> DataFrame:
    """(symbol, ts, funding_rate) snapped to 8 hours; the median of a file's times tells seconds from milliseconds."""
    df = raw.select(symbol.alias("symbol"), file.alias("_file"), first_number(raw, ["calc_time", "fundingTime", "timestamp", "ts"]).alias("_t"), first_number(raw, ["last_funding_rate", "fundingRate", "funding_rate", "rate"]).alias("funding_rate"))
    df = df.dropna(subset=["_t", "funding_rate"])
    units = df.groupBy("_file").agg(F.percentile("_t", F.lit(0.5)).alias("_mid"))
    seconds = F.when(F.col("_mid") > 1e11, F.col("_t") / 1000).otherwise(F.col("_t"))
    snapped = F.floor((seconds + 14400) / 28800) * 28800
    return df.join(units, "_file").select("symbol", F.timestamp_seconds(snapped).cast("timestamp_ntz").alias("ts"), "funding_rate")


#: Header names of a funding file's time and rate, in order of preference, without signs and in small letters.
FUNDING_TIME = ["fundingtime", "calctime", "timestamp", "time"]
FUNDING_RATE = ["fundingrate", "lastfundingrate"]


def parse_funding_files(raw: DataFrame, symbol: Column, file: Column) -> DataFrame:
    """(symbol, ts, funding_rate) from rows of text cells of files whose layouts differ, snapped to 8 hours.

    `raw` has the cells in its string columns, in order. A file with a row that names both a time and a rate column takes
    its cells there; any other file has the time first and the rate third (second, if no row has three cells). Times are
    seconds where the file's median is below 10^12, else milliseconds. One aggregate a file tells both. Rows whose time or
    rate is no number (headers too) are dropped.
    """
    cells = F.array(*[F.col(c) for c, kind in raw.dtypes if kind == "string"])
    width = sum(kind == "string" for _, kind in raw.dtypes)
    df = raw.select(symbol.alias("symbol"), file.alias("_file"), cells.alias("_cells"))
    named = F.transform("_cells", lambda c: F.regexp_replace(F.lower(F.trim(c)), "[_ ]", ""))
    place = lambda names: F.coalesce(*[F.nullif(F.array_position(named, n), F.lit(0)) for n in names])
    header = F.struct(place(FUNDING_TIME).alias("time"), place(FUNDING_RATE).alias("rate"))
    told = F.when(header["time"].isNotNull() & header["rate"].isNotNull(), header)
    three = F.max((F.size(F.array_compact("_cells")) >= 3)) if width >= 3 else F.lit(False)
    middles = F.array(*[F.percentile(number(F.col("_cells")[i]), F.lit(0.5)) for i in range(width)])
    layout = df.groupBy("_file").agg(F.max(told).alias("_named"), three.alias("_three"), middles.alias("_middles"))
    at_time = F.coalesce(F.col("_named.time"), F.lit(1)).cast("int")
    at_rate = F.coalesce(F.col("_named.rate"), F.when(F.col("_three"), 3).otherwise(2)).cast("int")
    layout = layout.select("_file", at_time.alias("_time"), at_rate.alias("_rate"), (F.get("_middles", at_time - 1) < 1e12).alias("_seconds"))
    rows = df.join(layout, "_file").select("symbol", "_seconds", number(F.get("_cells", F.col("_time") - 1)).alias("_t"), number(F.get("_cells", F.col("_rate") - 1)).alias("funding_rate")).dropna(subset=["_t", "funding_rate"])
    seconds = F.round(F.when(F.col("_seconds"), F.col("_t")).otherwise(F.col("_t") / 1000))
    return rows.select("symbol", F.timestamp_seconds(F.floor((seconds + 14400) / 28800) * 28800).cast("timestamp_ntz").alias("ts"), "funding_rate")


def read_funding(spark: SparkSession, path: str, symbol: Column, cells: int = 6) -> DataFrame:
    """parse_funding_files over all CSV files below a folder, each with at most `cells` columns."""
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(cells))).option("recursiveFileLookup", "true").csv(path)
    return parse_funding_files(raw.withColumn("_path", F.struct(F.col("_metadata.file_path").alias("p"))), symbol, F.col("_path.p"))


def parse_quotes(raw: DataFrame, symbol: Column) -> DataFrame:
    names = {"bid_price": ["best_bid_price", "bid_price"], "bid_qty": ["best_bid_qty", "bid_qty"], "ask_price": ["best_ask_price", "ask_price"], "ask_qty": ["best_ask_qty", "ask_qty"]}
    time = first_number(raw, ["transaction_time", "event_time", "timestamp"])
    return raw.select(symbol.alias("symbol"), from_epoch(time, F.lit(True)).alias("ts"), *[first_number(raw, n).alias(c) for c, n in names.items()]).dropna()


def by_magnitude(time: Column) -> Column:
    """A time from seconds or milliseconds since 1970, told apart by the row's own size (the limit is the year 5138)."""
    return F.when(time > 1e11, F.timestamp_millis(time.cast("long"))).otherwise(F.timestamp_seconds(time)).cast("timestamp_ntz")


def parse_mark_price(raw: DataFrame, symbol: Column) -> DataFrame:
    """(symbol, ts, mark_price): the close of kline rows."""
    df = raw.select(symbol.alias("symbol"), number("open_time").alias("_t"), number("close").alias("mark_price")).dropna(subset=["_t", "mark_price"])
    return df.select("symbol", from_epoch(F.col("_t"), F.lit(True)).alias("ts"), "mark_price")


def parse_liquidations(raw: DataFrame, symbol: Column) -> DataFrame:
    """Side, quantity, price and notional (given, or quantity times price); rows of no known side and exact repeats go."""
    quantity = first_number(raw, ["last_fill_quantity", "accumulated_fill_quantity", "original_quantity", "quantity"])
    price = first_number(raw, ["average_price", "price"])
    given = F.upper(F.trim("side"))
    side = F.when(given.isin("BUY", "B"), "BUY").when(given.isin("SELL", "S"), "SELL")
    notional = F.coalesce(first_number(raw, ["notional"]), F.abs(quantity * price))
    df = raw.select(symbol.alias("symbol"), by_magnitude(first_number(raw, ["time", "timestamp"])).alias("ts"), side.alias("side"), quantity.alias("quantity"), price.alias("price"), notional.alias("notional"))
    return df.dropna(subset=["ts", "side", "notional"]).dropDuplicates(["symbol", "ts", "side", "quantity", "price"])


def parse_open_interest(raw: DataFrame, symbol: Column) -> DataFrame:
    """(symbol, ts, open_interest) from snake or camel case headers and text or epoch times; of a time's rows the largest stays."""
    value = first_number(raw, ["sum_open_interest", "sumOpenInterest", "open_interest", "openInterest"])
    text = [F.col(c).try_cast("timestamp_ntz") for c in ("create_time", "timestamp", "time") if c in raw.columns]
    ts = F.coalesce(*text, by_magnitude(first_number(raw, ["timestamp", "time"])))
    return raw.select(symbol.alias("symbol"), ts.alias("ts"), value.alias("open_interest")).dropna().groupBy("symbol", "ts").agg(F.max("open_interest").alias("open_interest"))


def parse_onchain(raw: DataFrame, names: dict[str, str], suffix: str) -> DataFrame:
    """(symbol, ts, netflow_coin, mcap_usd); an asset's symbol is the mapped one, else the asset with the suffix."""
    mapped = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("asset")]
    return raw.select(F.coalesce(mapped, F.concat("asset", F.lit(suffix))).alias("symbol"), F.col("ts_event").alias("ts"), number("netflow_coin").alias("netflow_coin"), number("mcap_usd").alias("mcap_usd"))


def overlay(*tables: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Rows of all tables; where a key stands in several, that of the first table wins."""
    every = None
    for i, t in enumerate(tables):
        t = t.withColumn("_rank", F.lit(i))
        every = t if every is None else every.unionByName(t, allowMissingColumns=True)
    return every.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_rank"))).where("_n = 1").drop("_n", "_rank")


def write_months(df: DataFrame, path: str) -> None:
    """Parquet by symbol, year and month; only the partitions at hand are replaced."""
    df.withColumns({"year": F.year("ts"), "month": F.month("ts")}).write.partitionBy("symbol", "year", "month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
