"""Rolling aggregates over ordered panels, with a minimum number of values, and null rules for arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol",)


def ordered(keys: tuple[str, ...] = KEYS, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def rolling(value: Column, aggregate, rows: int, least: int | None = None, lag: int = 0, keys: tuple[str, ...] = KEYS, order: str = "ts") -> Column:
    """`aggregate(value)` over the last `rows` rows, ending `lag` rows back; null with fewer than `least` values (default: rows)."""
    frame = ordered(keys, order).rowsBetween(-(rows - 1 + lag), -lag)
    return F.when(F.count(value).over(frame) >= (rows if least is None else least), aggregate(value).over(frame))


def quantile(q: float):
    """Exact, linearly interpolated quantile, for `rolling` and groups."""
    return lambda x: F.percentile(x, F.lit(q))


def zscore(value: Column, rows: int, least: int | None = None, spread=F.stddev_samp, keys: tuple[str, ...] = KEYS, order: str = "ts") -> Column:
    """Distance from the rolling mean in rolling deviations; null where these are 0."""
    mean, sd = rolling(value, F.avg, rows, least, keys=keys, order=order), rolling(value, spread, rows, least, keys=keys, order=order)
    return (value - mean) / F.nullif(sd, F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is null."""
    return a / F.nullif(b, F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def without_nan(df: DataFrame, *names: str) -> DataFrame:
    """NaN becomes null, as it means missing in the sources."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def first_column(df: DataFrame, names: list[str], default: Column | None = None) -> Column:
    """The first of `names` that `df` has, else the default (null)."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None) if default is None else default)
