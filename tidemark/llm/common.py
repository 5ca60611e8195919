"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that end a word in the contracts' word pattern `[^\x20\x09-\x0D]+`.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo `modulus` (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where the id falls in the held-out fold; a null id is never held out."""
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(False))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    modulus: int,
    held_out: int,
    per_class: int,
    max_chars: int,
) -> tuple[list[tuple[int, str, int]], tuple[int, int]]:
    """(doc_id, text, label) of a bounded sample of labelled rows outside the held-out fold, and the
    numbers of all such labels 0 and 1, for the classes' true shares.

    The bound is 2 * `per_class` rows of at most `max_chars` characters. Rows are picked by the hash of
    their id, so the sample does not depend on partitioning. The picked labels are bounded, so they are
    broadcast and the texts are not shuffled. A label given twice counts as its largest value, a
    document given twice as its smallest text. Rows without a text, an id or a 0/1 label are skipped.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~in_fold(F.col("_id"), modulus, held_out))
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
    )
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = known.where("_y = 0").orderBy(*order).limit(per_class).unionByName(known.where("_y = 1").orderBy(*order).limit(per_class))
    rows = (
        docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
        .where(F.col("_text").isNotNull() & F.length("_text").between(1, max_chars))
        .join(F.broadcast(picked), "_id")
        .groupBy("_id")
        .agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
        .collect()
    )
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    return sorted((r["_id"], r["_text"], r["_y"]) for r in rows), (counts.get(0, 0), counts.get(1, 0))


def prior_shift(counts: tuple[int, int], y: np.ndarray) -> float:
    """What to add to an intercept fitted on labels `y` so that it suits the shares in `counts`."""
    pos, neg = float(np.sum(y)), float(np.sum(1 - y))
    return float(np.log((counts[1] + 1) / (counts[0] + 1)) - np.log((pos + 1) / (neg + 1)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (last one the intercept) of an L2-penalised logistic regression, by Newton's method.

    Platt's smoothed targets keep the weights finite on separable data. With one class only, or no rows,
    the slope is zero and the intercept is that class's smoothed log odds.
    """
    x = np.asarray(x, float).reshape(len(y), -1)
    pos, neg = float(np.sum(y)), float(np.sum(1 - y))
    if not pos or not neg:
        return np.r_[np.zeros(x.shape[1]), np.log((pos + 1) / (neg + 1))]
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a = np.c_[x, np.ones(len(y))]
    w = np.zeros(a.shape[1])
    pull = ridge * np.r_[np.ones(x.shape[1]), 0]
    for _ in range(steps):
        p = sigmoid(a @ w)
        g = a.T @ (p - target) + pull * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def join_by_key(rows: DataFrame, one: DataFrame, key: str, number: str, total: int, share: int = 10_000, least: int = 100) -> DataFrame:
    """`rows` joined with `one`, which has one row per `key` and, in `number`, about how many rows that key has.

    Keys with more than total / `share` rows (and more than `least`) are joined by broadcast, so that their rows stay
    where they are; there are at most about `share` such keys, whatever the input. The others meet by shuffle.
    """
    limit = max(least, total // share)
    hot = F.broadcast(one.where(F.col(number) > limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(one.where(F.col(number) <= limit), key)
    return rows.join(hot, key).unionByName(cold)
