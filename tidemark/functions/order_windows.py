"""Order statistics of moving windows: medians, quantiles, ranks and robust scores, one value in and one out a bar.

A percentile over a sliding frame, or a list of the frame, sorts or searches the whole frame for every bar. Here the window
is kept in order while it moves, inside one time chunk of a key at a time (see time_chunks), so the cost of a bar grows with
the logarithm of the window, and a task holds one chunk.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class OrderStat:
    """A statistic of the last `rows` values of column `of`, ending `lag` bars back; null with fewer than `least` values.

    kind: `quantile` (share q, linear), `pct_rank` (share of values at most the current one), `avg_rank` (mean rank of the
    current one by ties, over their number) or `robust_z` (values cut at their 1 and 99 % quantiles, then the distance of
    the last from the median in median absolute deviations). Values are rounded to `digits` first, if given.
    """

    kind: str
    of: str
    rows: int
    least: int
    q: float = 0.5
    lag: int = 0
    digits: int | None = None

    def over(self, x: pd.Series) -> pd.Series:
        x = x.astype(float)
        if self.digits is not None:
            x = x.round(self.digits)
        x = x.shift(self.lag)
        window = x.rolling(self.rows, min_periods=self.least)
        if self.kind == "quantile":
            return window.quantile(self.q)
        if self.kind in ("pct_rank", "avg_rank"):
            return window.rank(method="max" if self.kind == "pct_rank" else "average", pct=True).where(x.notna())
        if self.kind == "robust_z":
            return pd.Series(robust_scores(x.to_numpy(), self.rows, self.least), index=x.index)
        raise ValueError(f"unknown order statistic {self.kind}")


class SortedWindow:
    """The values of a window in order."""

    def __init__(self):
        self.sorted: list[float] = []

    def move(self, new: float, old: float) -> None:
        """Takes `new` in and `old` out; a NaN is no value."""
        if old == old:
            del self.sorted[bisect_left(self.sorted, old)]
        if new == new:
            insort(self.sorted, new)

    def quantile(self, q: float) -> float:
        place = (len(self.sorted) - 1) * q
        low = int(place)
        high = min(low + 1, len(self.sorted) - 1)
        return self.sorted[low] + (place - low) * (self.sorted[high] - self.sorted[low])

    def deviation(self, k: int, middle: float, low: float, high: float) -> float:
        """The k-th smallest (from 0) distance from `middle`, which lies among the values, of the values cut to [low, high].

        To the right of the middle distances rise, to the left they fall: two ordered lists, merged by halving.
        """
        a = self.sorted
        cut = lambda i: min(max(a[i], low), high)
        split = bisect_left(a, middle)
        left, right = split, len(a) - split  # distances middle - cut(split - 1 - i) and cut(split + i) - middle
        least, most = max(0, k + 1 - right), min(left, k + 1)  # how many of the k + 1 smallest are on the left
        while least < most:
            i = (least + most) // 2
            if cut(split + k - i) - middle > middle - cut(split - 1 - i):
                least = i + 1
            else:
                most = i
        own = middle - cut(split - least) if least else 0.0
        other = cut(split + k - least) - middle if k + 1 - least else 0.0
        return max(own, other)


def robust_scores(x: np.ndarray, rows: int, least: int, tails: float = 0.01) -> np.ndarray:
    window, out = SortedWindow(), np.full(len(x), np.nan)
    values = x.tolist()
    for t, now in enumerate(values):
        window.move(now, values[t - rows] if t >= rows else float("nan"))
        n = len(window.sorted)
        if now == now and n >= max(least, 1):
            low, high = window.quantile(tails), window.quantile(1 - tails)
            cut = lambda v: min(max(v, low), high)  # noqa: B023, E731
            middle = (cut(window.sorted[(n - 1) // 2]) + cut(window.sorted[n // 2])) / 2
            mad = (window.deviation((n - 1) // 2, middle, low, high) + window.deviation(n // 2, middle, low, high)) / 2
            out[t] = (cut(now) - middle) / (1.4826 * mad + 1e-12)
    return out


def add_order_statistics(df: DataFrame, stats: dict[str, OrderStat], keys: tuple[str, ...], order: str = "ts") -> DataFrame:
    """`df` with the statistics as columns, each within `keys`, whose groups must fit a task (a chunk of a key does)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        return pd.concat([part, pd.DataFrame({n: s.over(part[s.of]) for n, s in stats.items()}, index=part.index)], axis=1)

    return df.groupBy(*keys).applyInPandas(run, T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in stats]]))


def add_level(df: DataFrame, level: dict[str, Column | OrderStat], keys: tuple[str, ...]) -> DataFrame:
    """Columns first, then the order statistics, which may look at them."""
    stats = {n: c for n, c in level.items() if isinstance(c, OrderStat)}
    df = df.withColumns({n: c for n, c in level.items() if n not in stats})
    return add_order_statistics(df, stats, keys) if stats else df
