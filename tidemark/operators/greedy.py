"""Greedy selection along time, in blocks, without a sequential pass over a key.

Keeping a row forbids the following ones up to a place of its own. What a block of places does to the first place that is
still free when it begins is a step function, and every row of the block needs to be looked at once to make it. So each
block is turned into that function by a task of its own, the functions of a key are applied one after the other (one small
row a block), and each block then keeps its rows, now that it knows where it may begin. A key with very many rows, even
all of them close together, is the work of many tasks, and each needs memory for one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import durable

#: Places in a block.
BLOCK = 65_536


def following(enter: np.ndarray, free: np.ndarray) -> np.ndarray:
    """For each row, in order of `enter`, the first row at or after the place that it leaves free."""
    return np.maximum(np.searchsorted(enter, free, "left"), np.arange(1, len(enter) + 1))


def step_function(enter: np.ndarray, free: np.ndarray) -> tuple[list[int], list[int]]:
    """(upto, out): beginning at a place of at most upto[k], and more than upto[k - 1], a block leaves out[k] free."""
    after, n = following(enter, free).tolist(), len(enter)
    left = free.tolist()
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            left[i] = left[after[i]]
    upto, out = [], []
    for place, x in zip(enter.tolist(), left):
        if out and out[-1] == x:
            upto[-1] = place
        else:
            upto.append(place)
            out.append(x)
    return upto, out


def kept_rows(enter: np.ndarray, free: np.ndarray, begin: int) -> list[int]:
    """Numbers of the rows kept when the first may lie at `begin`."""
    after, i, out = following(enter, free).tolist(), int(np.searchsorted(enter, begin, "left")), []
    while i < len(after):
        out.append(i)
        i = after[i]
    return out


def greedy(rows: DataFrame, by: list[str], enter: str, free: str, block: int = BLOCK) -> DataFrame:
    """The rows kept when each must have its `enter` at or beyond the `free` of the last kept one of its key.

    Of rows with the same `enter` one is kept at most, that with the smallest `free`. Rows without `enter` or `free` are
    left out; a null key is a key. An empty table gives no rows.
    """
    names = [f"_greedy_key{i}" for i in range(len(by))]
    base = rows.where(F.col(enter).isNotNull() & F.col(free).isNotNull()).withColumns(
        {k: F.col(c).cast("string") for k, c in zip(names, by, strict=True)} | {"_greedy_enter": F.col(enter).cast("long"), "_greedy_free": F.col(free).cast("long"), "_greedy_block": F.floor(F.col(enter) / block).cast("long")}
    )
    base = durable(base)  # looked at twice, and few against what they were found in
    keys = ", ".join(f"{k} string" for k in names)

    def tables(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_greedy_enter", "_greedy_free"])
        upto, out = step_function(part["_greedy_enter"].to_numpy(), part["_greedy_free"].to_numpy())
        return pd.DataFrame([[*key, int(part["_greedy_enter"].iloc[0]), upto, out]], columns=[*names, "_greedy_block", "first", "upto", "out"])

    def chain(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        begin, found = None, []
        for b, first, upto, out in blocks.sort_values("_greedy_block")[["_greedy_block", "first", "upto", "out"]].itertuples(index=False):
            begin = first if begin is None else begin
            found.append((*key, b, begin))
            k = int(np.searchsorted(upto, begin, "left"))
            begin = int(out[k]) if k < len(out) else begin
        return pd.DataFrame(found, columns=[*names, "_greedy_block", "_greedy_begin"])

    steps = base.select(*names, "_greedy_block", "_greedy_enter", "_greedy_free").groupBy(*names, "_greedy_block").applyInPandas(tables, f"{keys}, _greedy_block long, first long, upto array<long>, out array<long>")
    begins = steps.groupBy(*names).applyInPandas(chain, f"{keys}, _greedy_block long, _greedy_begin long")
    same = [base[k].eqNullSafe(begins[k]) for k in names] + [base["_greedy_block"] == begins["_greedy_block"]]
    # rows before the block's first free place are out without a look
    open_ = base.join(begins, same).where(base["_greedy_enter"] >= begins["_greedy_begin"]).select(*[base[c] for c in base.columns], "_greedy_begin")

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_greedy_enter", "_greedy_free"])
        return part.iloc[kept_rows(part["_greedy_enter"].to_numpy(), part["_greedy_free"].to_numpy(), int(part["_greedy_begin"].iloc[0]))].drop(columns=["_greedy_begin", "_greedy_block", "_greedy_enter", "_greedy_free", *names])

    return open_.groupBy(*names, "_greedy_block").applyInPandas(keep, rows.schema)


def space_out(hits: DataFrame, by: list[str], index: str, gap: int | str, block: int = BLOCK) -> DataFrame:
    """The hits kept when each must lie `gap` or more after the last kept one of its key.

    `gap` is a number or the name of a column that is constant within a key.
    """
    step = F.col(gap) if isinstance(gap, str) else F.lit(gap)
    return greedy(hits.withColumn("_greedy_to", F.col(index) + step), by, index, "_greedy_to", block).drop("_greedy_to")


def cool_down(spans: DataFrame, by: list[str], enter: str, leave: str, wait: int, block: int = BLOCK) -> DataFrame:
    """The spans kept when each must begin more than `wait` after the last kept one of its key has ended."""
    return greedy(spans.withColumn("_greedy_to", F.col(leave) + wait + 1), by, enter, "_greedy_to", block).drop("_greedy_to")
