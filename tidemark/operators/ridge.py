"""Ridge regression on residualised features, its penalty chosen by walk-forward folds, from moments alone.

Rows are dealt into blocks of equal size along time. One pass sums each block's products of features and label (a Gram
matrix a block); sums of the first blocks are the moments of any training fold. Standardising, residualising and solving
are algebra on these matrices, whose size the number of features bounds, and so is the correlation of a fit with the label
on a later block: a fit is linear, so its variance and covariance follow from the block's own moments. The rows are read
once, however many penalties and folds there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_blocks(rows: DataFrame, order: list[str], bucket: Column, blocks: int) -> DataFrame:
    """Adds `block`: 0 to blocks - 1, cut at floor(i * n / blocks) of the rows in the given, total order.

    `bucket` is a coarser time that rises with the order; rows are numbered within a bucket, and only the buckets' counts
    are added up in one place.
    """
    marked = rows.withColumn("_bucket", bucket)
    counts = marked.groupBy("_bucket").agg(F.count("*").alias("_n"))
    every = Window.orderBy("_bucket")
    sums = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy())}).drop("_n")
    # numbered from 1, k is in the block i with floor(i * n / blocks) < k <= floor((i + 1) * n / blocks)
    numbered = marked.join(sums, "_bucket").withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return numbered.withColumn("block", F.expr(f"(_k * {blocks} - 1) div _all").cast("int")).drop("_bucket", "_before", "_all", "_k")


def block_moments(rows: DataFrame, features: list[str], label: str, blocks: int) -> np.ndarray:
    """(blocks, k + 2, k + 2): sums of products of (1, features, label) of each block. Rows with a null among them are left out.

    Values are taken from the means of the first pass, so that the sums lose no digits; the means are in the result's
    rows and columns again when it is returned.
    """
    names = [*features, label]
    known = rows.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in names)).select("block", *[F.col(c).cast("double") for c in names])
    means = np.array(known.agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in names]).first())
    width = len(names) + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            number = b.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(len(number)), *[b.column(i + 1).to_numpy(zero_copy_only=False) - means[i] for i in range(width - 1)]])
            for k in np.unique(number):
                part = x[number == k]
                total[int(k)] = total.get(int(k), 0) + part.T @ part
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width * width, k, np.int32)), pa.array(np.arange(width * width, dtype=np.int32)), pa.array(m.ravel())], ["block", "place", "value"])

    sums = known.mapInArrow(products, "block int, place int, value double").groupBy("block", "place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((blocks, width * width))
    for r in sums:
        out[r["block"], r["place"]] = r["value"]
    out = out.reshape(blocks, width, width)
    back = np.eye(width)
    back[1:, 0] = means
    return back @ out @ back.T


@dataclass
class Fit:
    """score = intercept + sum of beta * the residualised, standardised features."""

    mean: np.ndarray
    sd: np.ndarray
    steps: np.ndarray  # lower triangle: what of the residuals before it each feature loses
    beta: np.ndarray
    intercept: float
    penalty: float
    rows: int

    def weights(self) -> np.ndarray:
        """Intercept and weights of the raw features."""
        k = len(self.mean)
        turn = np.linalg.inv(np.eye(k) + self.steps) if k else np.zeros((0, 0))  # residuals of standardised features
        raw = (self.beta @ turn) / (self.sd + 1e-12)
        return np.r_[self.intercept - raw @ self.mean, raw]


def covariance(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and centred sums of products of (features, label) from sums of products with a leading 1."""
    n = m[0, 0]
    mean = m[0, 1:] / max(n, 1)
    return n, mean, m[1:, 1:] - n * np.outer(mean, mean)


def fit_moments(m: np.ndarray, penalty: float, residual: bool = True) -> Fit:
    """The fit of the rows behind `m`: features standardised, each freed of the ones before it, then ridge."""
    n, mean, c = covariance(m)
    k = len(mean) - 1
    sd = np.sqrt(np.maximum(np.diag(c)[:k], 0) / max(n - 1, 1))
    scale = 1 / (np.r_[sd, 1 - 1e-12] + 1e-12)
    g = c * np.outer(scale, scale)
    steps, turn = np.zeros((k, k)), np.eye(k)
    if residual:
        for j in range(1, k):
            gram = turn[:j] @ g[:k, :k] @ turn[:j].T
            steps[j, :j] = np.linalg.lstsq(gram, turn[:j] @ g[:k, j], rcond=1e-10)[0]
            turn[j] -= steps[j, :j] @ turn[:j]
    gram, cross = turn @ g[:k, :k] @ turn.T, turn @ g[:k, k]
    beta = np.linalg.solve(gram + penalty * np.eye(k), cross)
    return Fit(mean[:k], sd, steps, beta, float(mean[k]), penalty, int(n))


def correlation(fit: Fit, m: np.ndarray, least: int = 30) -> float:
    """Correlation of a fit with the label on the rows behind `m`; 0 with fewer than `least` rows or no variation."""
    if m[0, 0] < least:
        return 0.0
    _, _, c = covariance(m)
    w = fit.weights()[1:]
    variance, own = w @ c[:-1, :-1] @ w, c[-1, -1]
    return float(w @ c[:-1, -1] / np.sqrt(variance * own)) if variance > 0 and own > 0 else 0.0


def walk_forward(moments: np.ndarray, penalties: list[float], least_train: int = 100, least_test: int = 50, residual: bool = True) -> list[tuple[float, float, int]]:
    """(penalty, mean correlation, folds): each block from the second on is predicted from all blocks before it."""
    before = np.cumsum(moments, axis=0)
    folds = [(before[b - 1], moments[b]) for b in range(1, len(moments)) if before[b - 1][0, 0] >= least_train and moments[b][0, 0] >= least_test]
    return [(p, float(np.mean([correlation(fit_moments(a, p, residual), z) for a, z in folds])) if folds else 0.0, len(folds)) for p in penalties]


def ridge_fit(moments: np.ndarray, penalties: list[float], residual: bool = True) -> tuple[Fit, list[tuple[float, float, int]]]:
    """The fit on all blocks with the penalty of the highest mean correlation (of equal ones the first), and all of them."""
    tried = walk_forward(moments, penalties, residual=residual)
    return fit_moments(moments.sum(0), max(tried, key=lambda t: t[1])[0], residual), tried


def score(fit: Fit, features: list[str]) -> Column:
    """The fit as a Column; null where a feature is."""
    w = fit.weights().tolist()
    out = F.lit(w[0])
    for c, x in zip(features, w[1:], strict=True):
        out = out + F.lit(x) * F.col(c)
    return out
