"""Sharing out exposure among the strategies of a book: caps, scaling by regime, volatility and drawdown, and a bound on
what a bar may add.

The caps look at one bar, so they are windows over a bar's strategies. The running figures of a book (equity, its peak) are
cut into chunks of its bars: each chunk is reduced to one row, these are chained, and each chunk goes on from where the ones
before leave it. The bound on new exposure makes a bar depend on the one before; a chunk's effect on the position it begins
with is a rising line with slopes 0 and 1, so it too is one small row, and a long book is the work of many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain as flat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import clip, without_nan
from .lineage import durable

#: Bars of a chunk.
CHUNK = 8192


@dataclass(frozen=True)
class Limits:
    """Caps on the sum of absolute positions at a bar; None switches a rule off.

    `strategy`: one strategy; `symbol` and, after all scaling, `portfolio`: all of a book; `one_sided`: a book whose positions
    all point one way; `step`: change of a strategy from bar to bar. `volatility` is the wanted yearly deviation of the profit, taken
    over the last `window` bars (`least` at least) of which a year has `bars_a_year`, and scales positions by at most
    `most_leverage`. `drawdown` is the loss from the peak at which nothing may be held. `regimes` maps labels to scales.
    """

    strategy: float = 1.0
    symbol: float = 1.0
    portfolio: float = 1.0
    one_sided: float | None = None
    step: float = 1.0
    volatility: float | None = None
    drawdown: float | None = None
    regimes: tuple[tuple[str, float], ...] = ()
    window: int = 5760
    least: int = 288
    bars_a_year: float = 105_120.0
    most_leverage: float = 2.0

    def __post_init__(self):
        if self.drawdown is not None and self.drawdown <= 0:
            raise ValueError("the drawdown limit must be above 0")
        if not np.isfinite(self.portfolio):
            raise ValueError("the portfolio cap must be finite: it bounds what a chunk can begin with")


def in_chunks(df: DataFrame, by: list[str], time: str, chunk: int = CHUNK, seconds: int = 30 * 86_400) -> DataFrame:
    """Adds `_place` (0, 1, ... in order of time within a key, one row a time) and `_chunk`, its multiple of `chunk`.

    Rows are sorted within spans of `seconds`; only the spans' counts are added up over a key. Rows without a time are left out.
    """
    span = df.withColumn("_span", F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000)))
    counts = span.groupBy(*by, "_span").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_span").alias("_s"), before.alias("_before"))
    here = F.row_number().over(Window.partitionBy(*by, "_span").orderBy(time)) - 1
    joined = span.withColumn("_here", here).join(sums, _same(by, "_b") & (F.col("_span") == F.col("_s")))
    place = (F.col("_before") + F.col("_here")).cast("long")
    return joined.withColumn("_place", place).withColumn("_chunk", F.floor(F.col("_place") / chunk)).drop("_span", "_s", "_before", "_here", *[f"_b{i}" for i in range(len(by))])


def _same(by: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{i}"))
    return out


def drawdowns(profit: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """(by, time, equity, drawdown) of rows with `_chunk`: equity is the product of 1 + profit, drawdown the share lost from its peak.

    Null profit counts as 0. Where the peak is 0 the drawdown is 0. The chunks are reduced to their product and the ends of their
    range, which are chained over a key.
    """
    w = Window.partitionBy(*by, "_chunk").orderBy(time)
    p = profit.select(*by, time, "_chunk", F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(w).alias("_local"))
    ends = p.groupBy(*by, "_chunk").agg(F.max_by("_local", time).alias("_whole"), F.max("_local").alias("_high"), F.min("_local").alias("_low"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_begin", F.coalesce(F.product("_whole").over(before), F.lit(1.0)))
    ends = ends.withColumn("_top", F.max(F.col("_begin") * F.when(F.col("_begin") >= 0, F.col("_high")).otherwise(F.col("_low"))).over(before))
    ends = ends.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_chunk").alias("_c"), "_begin", "_top")
    p = p.join(ends, _same(by, "_b") & (F.col("_chunk") == F.col("_c"))).withColumn("equity", F.col("_begin") * F.col("_local"))
    peak = F.greatest(F.max("equity").over(w), "_top")  # greatest skips the null of the first chunk
    return p.withColumn("_peak", peak).select(*by, time, "equity", F.coalesce((F.col("_peak") - F.col("equity")) / F.nullif("_peak", F.lit(0.0)), F.lit(0.0)).alias("drawdown"))


def deviations(profit: DataFrame, by: list[str], time: str, value: str, window: int, least: int, chunk: int = CHUNK) -> DataFrame:
    """(by, time, sd): deviation over the last `window` rows, null with fewer than `least`, of rows with `_place` and `_chunk`.

    A row also goes to the later chunks that look back to it, so a chunk is rolled by itself.
    """
    rows = profit.select(*by, time, "_place", F.coalesce(F.col(value), F.lit(0.0)).alias("_x"), F.explode(F.sequence(F.col("_chunk"), F.floor((F.col("_place") + window - 1) / chunk))).alias("_to"))

    def roll(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place")
        part["sd"] = part["_x"].rolling(window, min_periods=least).std()
        return part[part["_place"] // chunk == part["_to"]][[*by, time, "sd"]]

    kinds = dict(profit.dtypes)
    return without_nan(rows.groupBy(*by, "_to").applyInPandas(roll, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"`{time}` {kinds[time]}", "sd double"])), "sd")


# --- the bound on change ------------------------------------------------------------------------------------


def step_line(targets: np.ndarray, step: float, reach: float) -> tuple[list[float], list[float]]:
    """(begin, end): the points of the line that leads from a chunk's first position, within +-reach, to its last.

    Each bar moves the position to its target, by at most `step`. The line rises with slope 1 between flat pieces, each of
    which takes part of the reach, so it has few points; once it is flat all over, one position is followed on.
    """
    u, v = np.array([-reach, reach]), np.array([-reach, reach])
    for i, x in enumerate(targets):
        if v[0] == v[-1]:
            end = last_position(targets[i:], step, float(v[0]))[-1]
            return [-reach, reach], [end, end]
        kinks = [k for k in (x - step, x + step) if v[0] < k < v[-1]]
        for k in kinks:
            j = int(np.searchsorted(v, k, "left"))
            if v[j] != k:
                u, v = np.insert(u, j, u[j - 1] + (k - v[j - 1])), np.insert(v, j, k)
        v = np.clip(x, v - step, v + step)
        if kinks and len(v) > 2:
            level = np.diff(v) == 0
            keep = np.r_[True, ~(level[:-1] & level[1:]), True]
            u, v = u[keep], v[keep]
    return u.tolist(), v.tolist()


def last_position(targets: np.ndarray, step: float, begin: float) -> list[float]:
    """The positions at all bars when the one before the first is `begin`."""
    out = []
    for x in targets.tolist():
        begin = x if abs(x - begin) <= step else begin + (step if x > begin else -step)
        out.append(begin)
    return out


def bounded_steps(rows: DataFrame, by: list[str], value: str, step: float, reach: float) -> DataFrame:
    """`rows` with `value` replaced by the position that follows it, by at most `step` a row, from 0 on.

    Rows have `_place` and `_chunk`; |value| is at most `reach`. Null keys are keys.
    """
    names = [f"_step_key{i}" for i in range(len(by))]
    base = durable(rows.withColumns({n: F.col(c).cast("string") for n, c in zip(names, by, strict=True)}))  # looked at twice
    keys = ", ".join(f"{n} string" for n in names)

    def lines(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        u, v = step_line(part.sort_values("_place")["_v"].to_numpy(), step, reach)
        return pd.DataFrame([[*key, u, v]], columns=[*names, "_chunk", "u", "v"])

    def begins(key: tuple, chunks: pd.DataFrame) -> pd.DataFrame:
        at, found = 0.0, []
        for c, u, v in chunks.sort_values("_chunk")[["_chunk", "u", "v"]].itertuples(index=False):
            found.append((*key, c, at))
            at = float(np.interp(at, u, v))
        return pd.DataFrame(found, columns=[*names, "_c", "_at"])

    made = base.select(*names, "_chunk", "_place", F.col(value).cast("double").alias("_v")).groupBy(*names, "_chunk").applyInPandas(lines, f"{keys}, _chunk long, u array<double>, v array<double>")
    start = made.groupBy(*names).applyInPandas(begins, f"{keys}, _c long, _at double")
    start = start.withColumnsRenamed({n: f"{n}_" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names] + [F.col("_chunk") == F.col("_c")]

    columns = rows.columns

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place")
        part[value] = last_position(part[value].to_numpy(), step, float(part["_at"].iloc[0]))
        return part[columns]

    return base.join(start, same).groupBy(*names, "_chunk").applyInPandas(follow, rows.schema)


# --- the whole ------------------------------------------------------------------------------------------------


def allocate(positions: DataFrame, by: list[str], time: str, strategy: str, limits: Limits, profit: DataFrame | None = None, regimes: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """(by, time, strategy, requested, allocated, scale) for every strategy at every time of its book.

    `positions` has one row a book, time and strategy with `position` and `scale`; nulls are 0, scales below 0 too, and a
    strategy without a row at a time of its book wants 0. `profit` (by, time, pnl) and `regimes` (by, time, regime) have at most one row a
    book and time; what they lack, null and unknown labels scale by 1. In this order: cap of a strategy, of the book, of a
    one-sided book, regime, volatility and drawdown, cap of the portfolio, bound on change. `scale` is what is left of a position, 0
    where it is 0. An empty table gives no rows. `by` names at least one key; null keys are keys.
    """
    if not by:
        raise ValueError("a book has at least one key")
    positions = durable(positions.select(*by, time, strategy, "position", "scale"))  # read for its times, names and values
    times = in_chunks(positions.select(*by, time).distinct(), by, time, chunk)
    b = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    held = positions.select(*b, F.col(time).alias("_t"), F.col(strategy).alias("_s"), F.coalesce(F.col("position").cast("double"), F.lit(0.0)).alias("_position"), F.greatest(F.coalesce(F.col("scale").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("_scale"))
    names = positions.select(*b, F.col(strategy).alias("_name")).distinct()
    overlay = F.lit(1.0)
    if profit is not None and (limits.volatility is not None or limits.drawdown is not None):
        own = profit.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(by)], F.col(time).alias("_t"), F.col("pnl").cast("double").alias("_pnl"))
        times = times.join(own, _same(by, "_p") & (F.col(time) == F.col("_t")), "left").drop("_t", *[f"_p{i}" for i in range(len(by))])
        times = durable(times)  # read by each of the running figures
        for name, figures in (("sd", deviations(times, by, time, "_pnl", limits.window, limits.least, chunk) if limits.volatility is not None else None), ("drawdown", drawdowns(times, by, time, "_pnl") if limits.drawdown is not None else None)):
            if figures is not None:
                figures = figures.select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(by)], F.col(time).alias("_t"), F.col(name).alias(f"_{name}"))
                times = times.join(figures, _same(by, "_f") & (F.col(time) == F.col("_t"))).drop("_t", *[f"_f{i}" for i in range(len(by))])
        if limits.volatility is not None:
            overlay = overlay * F.coalesce(clip(limits.volatility / F.nullif(F.col("_sd") * limits.bars_a_year**0.5, F.lit(0.0)), 0.0, limits.most_leverage), F.lit(1.0))
        if limits.drawdown is not None:
            overlay = overlay * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (limits.drawdown - F.col("_drawdown")) / limits.drawdown))
    if regimes is not None and limits.regimes:
        own = regimes.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(by)], F.col(time).alias("_t"), F.col("regime").alias("_regime"))
        times = times.join(own, _same(by, "_r") & (F.col(time) == F.col("_t")), "left")
        scales = F.create_map(*[F.lit(x) for x in flat.from_iterable((k, min(1.0, max(0.0, v))) for k, v in limits.regimes)])
        overlay = overlay * F.coalesce(F.try_element_at(scales, F.col("_regime")), F.lit(1.0))
    times = times.select(*by, time, "_place", "_chunk", overlay.alias("_overlay"))
    grid = times.join(names, _same(by, "_k")).drop(*[f"_k{i}" for i in range(len(by))])
    x = grid.join(held, _same(by, "_k") & (F.col(time) == F.col("_t")) & F.col("_name").eqNullSafe(F.col("_s")), "left")
    x = x.select(*by, time, F.col("_name").alias(strategy), "_place", "_chunk", "_overlay", F.coalesce("_position", F.lit(0.0)).alias("_position"), F.coalesce(F.col("_position") * F.col("_scale"), F.lit(0.0)).alias("requested"))
    bar = Window.partitionBy(*by, time)

    def within(cap: float) -> Column:
        gross = F.sum(F.abs("allocated")).over(bar)
        return F.when(gross > cap, cap / gross).otherwise(1.0)

    cap = max(0.0, limits.strategy)
    x = x.withColumn("allocated", F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("requested"))))
    x = x.withColumn("allocated", F.col("allocated") * within(max(0.0, limits.symbol)))
    if limits.one_sided is not None:
        gross, net = F.sum(F.abs("allocated")).over(bar), F.sum("allocated").over(bar)
        most = max(0.0, limits.one_sided)
        x = x.withColumn("allocated", F.col("allocated") * F.when((F.abs(F.abs(net) - gross) < 1e-9) & (gross > most), most / gross).otherwise(1.0))
    x = x.withColumn("allocated", F.col("allocated") * F.col("_overlay"))
    most = max(0.0, limits.portfolio)
    x = x.withColumn("allocated", F.col("allocated") * within(most))
    x = bounded_steps(x, [*by, strategy], "allocated", max(0.0, limits.step), most * (1 + 1e-9) + 1e-12)
    return x.select(*by, time, strategy, "requested", "allocated", F.coalesce(F.abs("allocated") / F.nullif(F.abs("_position"), F.lit(0.0)), F.lit(0.0)).alias("scale"))


def allocation_summary(allocated: DataFrame, by: list[str]) -> DataFrame:
    """(by, requested_gross, allocated_gross, clipped_fraction) of what `allocate` returns; 0 clipped where nothing was wanted."""
    want, got = F.sum(F.abs("requested")), F.sum(F.abs("allocated"))
    return allocated.groupBy(*by).agg(want.alias("requested_gross"), got.alias("allocated_gross"), F.when(want > 0, F.greatest(F.lit(0.0), (want - got) / want)).otherwise(0.0).alias("clipped_fraction"))
