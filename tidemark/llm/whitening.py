"""Whitening directions of embeddings from a singular value decomposition of the centred rows.

The rows are never multiplied into a covariance: they are centred exactly (as whole numbers n * x - S) and reduced by QR,
block by block in each task and then in a tree over tasks, to one triangle R of the dimension's size, with the same
singular values and right singular vectors. On R, whose size the dimension bounds:

1. Householder reflections from both sides make R upper bidiagonal; those from the right are kept.
2. dqds (differential quotient-difference with shifts) finds the squared singular values to high relative accuracy. The
   shift is Newton's: one over the trace of the inverse, which the unshifted transform gives, never exceeds the smallest.
3. Twisted factorisations give the vectors: the stationary transform from the top and the progressive one from the
   bottom meet where the residual is smallest. Vectors of values that lie close together are made orthogonal.

Tasks hold one block of rows and one triangle; every step is a sum or a tree over tasks, and a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = np.finfo(float).eps


def bidiagonalize(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, v) with r = u @ bidiagonal @ v.T for some orthogonal u, by Householder reflections."""
    a = np.array(r, float)
    n = len(a)
    v = np.eye(n)
    for k in range(n):
        h = reflector(a[k:, k])
        a[k:] -= np.outer(2 * h, h @ a[k:])
        if k < n - 2:
            h = reflector(a[k, k + 1 :])
            a[:, k + 1 :] -= np.outer(a[:, k + 1 :] @ h, 2 * h)
            v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ h, 2 * h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def reflector(x: np.ndarray) -> np.ndarray:
    """The unit vector whose reflection leaves of `x` the first entry alone; zeros where it is so already."""
    h = np.array(x, float)
    if not np.any(h[1:]):
        return np.zeros(len(h))
    h /= np.abs(h).max()
    h[0] += np.copysign(np.sqrt(h @ h), h[0])
    return h / np.sqrt(h @ h)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, from the largest."""
    todo = [((diagonal**2).tolist(), (above**2).tolist(), 0.0)]
    out: list[float] = []
    while todo:
        q, e, sigma = todo.pop()
        limit = 100 * len(q) + 1000
        while q:
            n = len(q)
            if n == 1 or e[-1] <= (EPS * 1e-2) * (sigma + q[-1]) and e[-1] <= EPS * q[-1] + EPS**2 * sigma or e[-1] < 1e-300:
                out.append(sigma + q.pop())
                if e:
                    e.pop()
                continue
            if (k := next((i for i in range(n - 2, -1, -1) if e[i] <= EPS**2 * (sigma + q[i]) or e[i] < 1e-300), None)) is not None:
                todo.append((q[: k + 1], e[:k], sigma))
                q, e = q[k + 1 :], e[k + 1 :]
                continue
            q0, e0, d = transform(q, e, 0.0)
            if min(d) <= 0:  # a singular matrix: the unshifted step brings its zero to the end
                q, e = q0, e0
            else:
                shift = (1 - 4 * EPS * n) / sum(1 / x for x in d)
                q1, e1, d1 = transform(q, e, shift)
                if min(d1) >= 0:
                    q, e, sigma = q1, e1, sigma + shift
                else:
                    q, e = q0, e0
            limit -= 1
            if limit < 0:
                raise ArithmeticError("singular values did not settle")
    return np.sort(np.array(out))[::-1]


def transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential quotient-difference step, and its differences d."""
    d, qs, es, ds = q[0] - shift, [], [], []
    for i in range(len(e)):
        ds.append(d)
        x = d + e[i]
        t = q[i + 1] / x if x else 0.0
        qs.append(x)
        es.append(e[i] * t)
        d = d * t - shift if x else q[i + 1] - shift
    ds.append(d)
    qs.append(d)
    return qs, es, ds


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of the tridiagonal B.T @ B for an eigenvalue, by a twisted factorisation."""
    n = len(diagonal)
    q = diagonal**2
    ratio = np.divide(above, diagonal[:-1], out=np.zeros(n - 1), where=diagonal[:-1] != 0)  # of the unit lower factor
    tiny = max(EPS**2 * float(q.max(initial=0)), 1e-300)
    s, p, lower, upper = np.empty(n), np.empty(n), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        d = s[i] + q[i]
        lower[i] = ratio[i] * q[i] / (d or tiny)
        s[i + 1] = lower[i] * ratio[i] * s[i] - value
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        d = q[i] * ratio[i] ** 2 + p[i + 1]
        upper[i] = ratio[i] * q[i] / (d or tiny)
        p[i] = p[i + 1] * (q[i] / (d or tiny)) - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1
    for i in range(k - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -upper[i] * z[i]
    return z / np.sqrt(z @ z)


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The squared singular values of `r`, all of them from the largest, and right singular vectors (columns) of the
    first `most`.

    A bidiagonal matrix that falls apart is taken part by part, so values that several parts share have one vector in
    each. Vectors of close values (relative gap under a thousandth) are made orthogonal, and the pencil of r on them is
    turned into its own directions.
    """
    scale = float(np.abs(r).max(initial=0)) or 1.0
    diagonal, above, v = bidiagonalize(r / scale)
    n = len(diagonal)
    # what is below rounding of its neighbours is no coupling; a zero on the diagonal would be no pivot
    diagonal = np.where(np.abs(diagonal) < EPS * 1e-3 * np.abs(diagonal).max(initial=0), EPS * 1e-3 * np.abs(diagonal).max(initial=0), diagonal)
    above = np.where(np.abs(above) <= EPS * np.minimum(np.abs(diagonal[:-1]), np.abs(diagonal[1:])), 0.0, above)
    starts = [0, *(np.flatnonzero(above == 0) + 1).tolist(), n]
    found = [(x, a, z) for a, z in zip(starts[:-1], starts[1:], strict=True) if z > a for x in dqds(diagonal[a:z], above[a : z - 1])]
    found.sort(key=lambda f: -f[0])
    vectors = np.zeros((n, 0))
    group = 0
    for i, (value, a, z) in enumerate(found[:most]):
        x = np.zeros(n)
        x[a:z] = twisted_vector(diagonal[a:z], above[a : z - 1], value)
        if i and found[i - 1][0] - value > 1e-3 * found[i - 1][0]:
            group = i
        others = vectors[:, group:]
        for _ in range(2):
            x -= others @ (others.T @ x)
        if x @ x < 0.25:  # mostly a direction that is there already
            x[a:z] = other_vector(diagonal[a:z], above[a : z - 1], value, others[a:z])
        vectors = np.column_stack([vectors, x / np.sqrt(x @ x)])
    vectors = refined(diagonal, above, vectors)
    return scale**2 * np.array([f[0] for f in found]), v @ vectors


def other_vector(diagonal: np.ndarray, above: np.ndarray, value: float, others: np.ndarray) -> np.ndarray:
    """A unit eigenvector of B.T @ B for a repeated eigenvalue that is orthogonal to `others`, by inverse iteration."""
    b = np.diag(diagonal) + np.diag(above, 1)
    shifted = b.T @ b - value * (1 + 8 * EPS) * np.eye(len(b))
    shifted += np.diag(np.where(np.diag(shifted) == 0, EPS * (value or 1), 0.0))
    x = np.random.default_rng(others.shape[1]).normal(size=len(b))
    for _ in range(6):
        for _ in range(2):
            x -= others @ (others.T @ x)
            x /= np.sqrt(x @ x)
        try:
            x = np.linalg.solve(shifted, x)
        except np.linalg.LinAlgError:
            shifted += EPS * (value or 1) * np.eye(len(b))
    for _ in range(2):
        x -= others @ (others.T @ x)
        x /= np.sqrt(x @ x)
    return x


def refined(diagonal: np.ndarray, above: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Vectors of close values, turned so that the bidiagonal matrix maps them to orthogonal ones (one-sided Jacobi)."""
    out = vectors.copy()
    image = diagonal[:, None] * out
    image[:-1] += above[:, None] * out[1:]
    for _ in range(12):
        turned = False
        for i in range(out.shape[1]):
            for j in range(i + 1, out.shape[1]):
                a, b, c = image[:, i] @ image[:, i], image[:, j] @ image[:, j], image[:, i] @ image[:, j]
                if abs(c) <= 4 * EPS * np.sqrt(a * b):
                    continue
                turned = True
                angle = 0.5 * np.arctan2(2 * c, a - b)
                co, si = np.cos(angle), np.sin(angle)
                for m in (out, image):
                    m[:, [i, j]] = np.column_stack([co * m[:, i] + si * m[:, j], co * m[:, j] - si * m[:, i]])
        if not turned:
            break
    return out


class Centred:
    """n * x - S of rows, as exact whole numbers where they fit 53 bits."""

    def __init__(self, n: int, sums: list[int], low: int, high: int):
        self.n, self.dim = n, len(sums)
        self.exact = np.array(sums, object)
        reach = n * (max(abs(low), abs(high)) + abs(high - low) + 1)
        self.small = reach < 2**62
        self.sums = np.array(sums, np.int64) if self.small else self.exact
        #: the sum of squares fits 63 bits
        self.fits = self.small and self.dim * (n * (high - low)) ** 2 < 2**63

    def whole(self, x: np.ndarray) -> np.ndarray:
        return (x if self.small else x.astype(object)) * self.n - self.sums

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return self.whole(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares of n * x - S; null where one needs more than 63 bits."""
        if self.fits:
            w = self.whole(x)
            return (w * w).sum(1).tolist()
        w = (x.astype(object) * self.n - self.exact) ** 2
        return [int(s) if s < 2**63 else None for s in w.sum(1)]


def vectors_of(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of `batch` have a usable vector of length `dim` (in its last column), and those as a matrix of longs."""
    column = batch.column(batch.num_columns - 1)
    lengths = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dim)
    if not len(right) or not dim:
        return right[:0], np.zeros((0, dim), np.int64)
    flat = column.take(pa.array(right)).flatten()
    c = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(right), dim)
    fine = np.isfinite(c).all(1)
    return right[fine], (np.floor(1024 * c[fine])).astype(np.int64) + 100_000


def summed(rows: DataFrame, run) -> list[float]:
    """Adds up (place, value) rows of all tasks; the places are bounded by the dimension."""
    parts = rows.mapInArrow(run, "place int, value double")
    return [r["value"] for r in parts.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()]


def common_length(rows: DataFrame) -> int:
    """The length that most usable vectors have, of equally common ones the greatest; 0 without any."""
    fine = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    best = fine.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return best["dim"] if best else 0


def fit(rows: DataFrame, dim: int) -> tuple[Centred, int]:
    """Number of usable vectors, exact sums per dimension and the range of entries, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, np.zeros(dim, np.int64), None, None
        for b in batches:
            _, x = vectors_of(b, dim)
            if len(x):
                n, sums = n + len(x), sums + x.sum(0)
                low, high = min(int(x.min()), x.max() if low is None else low), max(int(x.max()), x.min() if high is None else high)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(dim + 1)], pa.int32()), pa.array([n, *sums.tolist()], pa.int64()), pa.array([int(low)] * (dim + 1)), pa.array([int(high)] * (dim + 1))], ["place", "value", "low", "high"])

    parts = rows.mapInArrow(run, "place int, value long, low long, high long")
    total = parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("place").collect()
    n, *sums = [int(r["value"]) for r in total]
    return Centred(n, sums, total[0]["low"], total[0]["high"]), n


def triangle(rows: DataFrame, centred: Centred, fan_in: int = 16) -> np.ndarray:
    """R of a QR factorisation of all centred rows: by blocks in each task, then in a tree of `fan_in` triangles a step."""
    dim = centred.dim
    schema = "node long, r binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for b in batches:
            _, x = vectors_of(b, dim)
            for i in range(0, len(x), max(4 * dim, 1024)):
                block = centred.rows(x[i : i + max(4 * dim, 1024)])
                r = np.linalg.qr(block if r is None else np.vstack([r, block]), "r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()], pa.binary())], ["node", "r"])

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        stack = np.vstack([np.frombuffer(x).reshape(-1, dim) for x in group.sort_values("child")["r"]])
        return pd.DataFrame({"node": [int(group["node"].iloc[0])], "r": [np.linalg.qr(stack, "r").tobytes()]})

    level, width = rows.mapInArrow(blocks, schema), rows.rdd.getNumPartitions()
    while width > fan_in:
        level = level.select(F.floor(F.col("node") / fan_in).alias("node"), F.col("node").alias("child"), "r").groupBy("node").applyInPandas(merged, schema)
        width = -(-width // fan_in)
    last = [np.frombuffer(x["r"]).reshape(-1, dim) for x in level.orderBy("node").collect()]
    r = np.linalg.qr(np.vstack(last), "r")
    return np.vstack([r, np.zeros((dim - len(r), dim))])


def whiten(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and component.

    Rows whose vector is null, empty, holds null or non-finite entries, or has another length than most usable vectors (of
    equally common lengths the greatest counts) are left out. Entries become x = floor(1024 * c) + 100000. Components are
    numbered from 1 by falling eigenvalue of x's covariance; those with an eigenvalue of at most 1e-13 of the largest
    cannot be whitened and are left out, so one row, or equal rows alone, give none. Of equal eigenvalues any orthogonal
    directions are taken. `deviation` is exact, and null beyond 63 bits. `identity_error` is measured on the whitened
    values of all rows. Rows with a repeated or null vec_id, and repeated rows, count each. An empty table gives no rows;
    columns besides vec_id and embedding are left out.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    spark = embeddings.sparkSession
    dim = common_length(rows)
    if not dim:
        return spark.createDataFrame([], schema)
    centred, n = fit(rows, dim)
    squares, directions = right_singular(triangle(rows, centred), min(components, dim))
    keep = [i for i in range(directions.shape[1]) if squares[i] > 1e-13 * squares[0]] if squares[0] > 0 else []
    if not keep:
        return spark.createDataFrame([], schema)
    k = len(keep)
    eigen = squares[keep] / n
    turn = directions[:, keep] / np.sqrt(eigen)
    explained = (eigen / (squares.sum() / n)).tolist()

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            _, x = vectors_of(b, dim)
            if len(x):
                w = np.column_stack([np.ones(len(x)), centred.rows(x) @ turn])
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([*range((k + 1) ** 2)], pa.int32()), pa.array(total.ravel())], ["place", "value"])

    m = np.array(summed(rows, moments)).reshape(k + 1, k + 1) / n
    error = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                which, x = vectors_of(part, dim)
                if not len(x):
                    continue
                w = centred.rows(x) @ turn
                ids = part.column(0).take(pa.array(np.repeat(which, k)))
                deviation = np.repeat(np.array(centred.deviations(x), object), k)
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n, np.int64)), pa.array(deviation.tolist(), pa.int64()),
                    pa.array(w.ravel()), pa.array(explained * len(x)), pa.array(np.full(len(x) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
