"""Point-in-time joins and grids.

As-of joins are a union of both sides and one window function, so the row count of the left side cannot change and no pair
of rows is ever formed. The window runs over blocks of time: what reaches a block from before it (the last row on the
right, or how many spans are open) is one row, found from one row a block. So a long history of one key is the work of many
tasks. Interval flags are running sums of +1 and -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Length of a block: seconds of a time, or units of a whole number. Other numbers have one block, unless told otherwise.
BLOCK_SECONDS, BLOCK_UNITS = 7 * 86_400, 8_192


def block_of(on: str, kind: T.DataType, block: float | None = None) -> Column:
    """The number of the block that a time or number lies in (null: 0)."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        number = F.floor(F.unix_micros(F.col(on).cast("timestamp")) / F.lit(int((block or BLOCK_SECONDS) * 1_000_000)))
    elif block or isinstance(kind, T.IntegralType):
        number = F.floor(F.col(on) / F.lit(block or BLOCK_UNITS))
    else:
        number = F.lit(0)
    return F.coalesce(number.cast("long"), F.lit(0).cast("long"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: str = "ts",
    columns: list[str] | None = None,
    tolerance: Column | None = None,
    forward: bool = False,
    strict: bool = False,
    right_time: str = "matched_ts",
    block: float | None = None,
) -> DataFrame:
    """Each left row with the latest right row not after it (`forward`: the earliest not before it).

    `strict` leaves out equal times. `tolerance` is an interval; older matches count as none. A match
    carries its values even where they are null. Of right rows with the same time one is taken: the
    largest, comparing `columns` in order. A row without a time matches none, on either side. `block` is the
    length of a block (see block_of) and does not change the result.
    """
    columns = columns or [c for c in right.columns if c not in [*by, on]]
    kind = left.schema[on].dataType
    number = block_of(on, kind, block)
    packed = F.struct(F.col(on).cast(kind).alias("_t"), *columns)
    here = left.select(*by, on, number.alias("_block"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(packed.alias("x")).schema[0].dataType).alias("_right"))
    there = right.where(F.col(on).isNotNull()).withColumn(on, F.col(on).cast(kind)).select(*by, on, number.alias("_block"), F.lit(None).cast(here.schema["_left"].dataType).alias("_left"), packed.alias("_right"))
    handed = _handed_on(here, there, by, forward).select(*by, F.col("_right._t").alias(on), "_block", F.lit(None).cast(here.schema["_left"].dataType).alias("_left"), "_right")
    # right rows come before left rows of the same time in the frame's direction, after them if strict
    side = F.when(F.col("_left").isNull(), F.lit(2 if strict else 0)).otherwise(F.lit(1))
    time = F.col(on).desc_nulls_last() if forward else F.col(on).asc_nulls_first()
    window = Window.partitionBy(*by, "_block").orderBy(time, side, "_right").rowsBetween(Window.unboundedPreceding, 0)
    both = here.unionByName(there).unionByName(handed).withColumn("_match", F.last("_right", ignorenulls=True).over(window)).where("_left is not null")
    fits = F.col(on).isNotNull()
    if tolerance is not None:
        fits &= (F.col("_match._t") <= F.col(on) + tolerance) if forward else (F.col("_match._t") >= F.col(on) - tolerance)
    return both.withColumn("_match", F.when(fits, F.col("_match"))).select("_left.*", F.col("_match._t").alias(right_time), *[F.col(f"_match.{c}").alias(c) for c in columns])


def _handed_on(here: DataFrame, there: DataFrame, by: list[str], forward: bool) -> DataFrame:
    """For each block with left rows the right row that reaches it from the blocks before (`forward`: behind) it, if any."""
    if forward:
        numeric = isinstance(there.schema["_right"].dataType["_t"].dataType, T.NumericType)
        soon = -F.col("_right._t") if numeric else -F.unix_micros(F.col("_right._t").cast("timestamp"))
        end = F.max_by("_right", F.struct(soon.alias("soon"), F.col("_right").alias("row")))
    else:
        end = F.max("_right")
    ends = there.groupBy(*by, "_block").agg(end.alias("_right"), F.lit(False).alias("_asked"))
    asked = here.groupBy(*by, "_block").agg(F.first("_right").alias("_right"), F.lit(True).alias("_asked"))
    blocks = ends.unionByName(asked).groupBy(*by, "_block").agg(F.max("_right").alias("_own"), F.max("_asked").alias("_asked"))
    earlier = Window.partitionBy(*by).orderBy(F.col("_block").desc() if forward else F.col("_block").asc()).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("_right", F.last("_own", ignorenulls=True).over(earlier)).where("_asked and _right is not null").select(*by, "_block", "_right")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with their count: empty if the contract holds."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def grid_reindex(df: DataFrame, by: list[str], step: str, on: str = "ts") -> DataFrame:
    """Every step from each key's first to its last time, with the row of that time where there is one."""
    ends = df.groupBy(*by).agg(F.min(on).alias("_a"), F.max(on).alias("_b"))
    grid = ends.select(*by, F.explode(F.sequence("_a", "_b", F.expr(f"interval {step}"))).alias(on))
    return grid.join(df, [*by, on], "left")


def runs(df: DataFrame, flag: Column, by: list[str], on: str = "ts") -> DataFrame:
    """Adds run_id (number of the run of equal flags the row is in) and run_length."""
    order = Window.partitionBy(*by).orderBy(on)
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    change = (F.col("_flag") != F.coalesce(F.lag("_flag").over(order), ~F.col("_flag"))).cast("int")
    marked = marked.withColumn("run_id", F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("run_length", F.count("*").over(Window.partitionBy(*by, "run_id"))).drop("_flag")


def keep_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given, total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def active_on_grid(grid: DataFrame, spans: DataFrame, by: list[str], on: str = "ts", enter: str = "enter_ts", leave: str = "exit_ts", block: float | None = None) -> DataFrame:
    """The grid's rows with `active`: whether the time lies in [enter, leave] of some span of its key.

    Spans that end before they begin, or lack an end, count for nothing; a row without a time is never active. `block` is
    the length of a block (see block_of) and does not change the result.
    """
    zero, kind = F.lit(0).cast("long"), grid.schema[on].dataType
    ends = F.array(F.struct(F.col(enter).alias("t"), F.lit(0).alias("o"), F.lit(1).cast("long").alias("d")), F.struct(F.col(leave).alias("t"), F.lit(2).alias("o"), F.lit(-1).cast("long").alias("d")))
    number = block_of("_t", kind, block)
    none = F.lit(None).cast(grid.select(F.struct("*").alias("x")).schema[0].dataType).alias("_row")
    steps = (
        spans.where(F.col(leave) >= F.col(enter)).select(*by, F.explode(ends).alias("s")).select(*by, F.col("s.t").cast(kind).alias("_t"), F.col("s.o").alias("_o"), F.col("s.d").alias("_d"), none).withColumn("_block", number)
    )
    rows = grid.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_o"), zero.alias("_d"), F.struct("*").alias("_row")).withColumn("_block", number)
    # spans that are open when a block begins, for the blocks that have rows
    net = steps.groupBy(*by, "_block").agg(F.sum("_d").alias("_d"), F.lit(False).alias("_asked")).unionByName(rows.groupBy(*by, "_block").agg(F.sum("_d").alias("_d"), F.lit(True).alias("_asked")))
    blocks = net.groupBy(*by, "_block").agg(F.sum("_d").alias("_d"), F.max("_asked").alias("_asked"))
    open_ = F.sum("_d").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    handed = blocks.withColumn("_d", open_).where("_asked and _d <> 0").select(*by, F.lit(None).cast(kind).alias("_t"), F.lit(-1).alias("_o"), "_d", none, "_block")
    window = Window.partitionBy(*by, "_block").orderBy(F.col("_t").asc_nulls_first(), "_o").rowsBetween(Window.unboundedPreceding, 0)
    active = (F.sum("_d").over(window) > 0) & F.col("_t").isNotNull()
    return rows.unionByName(steps).unionByName(handed).withColumn("active", active).where("_row is not null").select("_row.*", "active")


def time_chunks(df: DataFrame, step_seconds: int, chunk: int, before: int, after: int, on: str = "ts") -> DataFrame:
    """Adds `_chunk`, the number of the span of `chunk` steps a row lies in, and copies rows into the chunks that need them.

    A row also goes to the next chunks if it lies in the `before` steps ahead of them, and to the previous one if it lies
    in the `after` steps behind it. So windows by key and `_chunk` that look no further are exact on the rows that
    `own_rows` keeps, and a long history of one key is the work of many tasks. The number comes from the time alone.
    """
    if max(before, after) > chunk:
        raise ValueError("a chunk must be at least as long as what it takes from its neighbours")
    step = F.floor(F.unix_micros(F.col(on).cast("timestamp")) / F.lit(step_seconds * 1_000_000)).cast("long")
    own, place = F.floor(step / F.lit(chunk)).cast("long"), F.pmod(step, F.lit(chunk))
    every = F.array_compact(F.array(own, F.when(place >= chunk - before, own + 1), F.when(place < after, own - 1)))
    return df.withColumn("_own", own).withColumn("_chunk", F.explode(every))


def own_rows(df: DataFrame) -> DataFrame:
    """What is left of `time_chunks` rows when the copies are taken off."""
    return df.where("_own = _chunk").drop("_own", "_chunk")
