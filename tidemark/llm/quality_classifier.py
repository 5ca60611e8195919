"""Quality by compression: which of two zstandard dictionaries makes a text smaller?

One dictionary is built from good, one from bad labelled text. A text is cut into chunks, every chunk is
compressed with both, and the difference of the two total sizes, divided by the text's bytes, goes
through a logistic curve fitted on labelled rows that neither dictionary has seen. The curve also knows
how short the text is, since a few words say little in either dictionary.

Scoring is one scan without a shuffle; the model is a few hundred KB whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, in_fold, labelled_sample, prior_shift, sigmoid


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and a calibration: `weights` for the size difference, for shortness, and the intercept."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]
    level: int = 3
    chunk: int = 2048

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        made = []
        for raw in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(raw)
            held.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(level=self.level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made[0], made[1]

    def measure(self, text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float]:
        """(size with the bad dictionary - size with the good one) / bytes, 0 for no text; 64 / (64 + bytes)."""
        raw = (text or "").encode("utf-8", "replace")
        total = 0
        for i in range(0, len(raw), self.chunk):
            part = raw[i : i + self.chunk]
            total += len(bad.compress(part)) - len(good.compress(part))
        return total / max(len(raw), 1), 64 / (64 + len(raw))

    def score(self, measures: np.ndarray) -> np.ndarray:
        return sigmoid(measures @ np.array(self.weights[:2]) + self.weights[2])


def fit_compression_model(rows: list[tuple[int, str, int]], counts: tuple[int, int], dict_bytes: int = 65536, level: int = 3, chunk: int = 2048, sample_bytes: int = 2048) -> CompressionModel:
    """Dictionaries from every other row of each class, the calibration from the rest.

    The intercept is moved to the class shares in `counts` (all labelled rows: label 0, label 1). A class with too few rows to train a dictionary uses its raw text as one. With no rows at all both
    dictionaries are the same and every score is 0.5.
    """
    content = {0: [], 1: []}
    held = []
    seen = {0: 0, 1: 0}
    for _, text, y in rows:
        if seen[y] % 2 == 0:
            raw = text.encode("utf-8", "replace")
            content[y] += [raw[i : i + sample_bytes] for i in range(0, len(raw), sample_bytes)]
        else:
            held.append((text, y))
        seen[y] += 1

    def build(samples: list[bytes]) -> bytes:
        try:
            return zstandard.train_dictionary(dict_bytes, samples, level=level).as_bytes()
        except zstandard.ZstdError:
            return (b"".join(samples))[-dict_bytes:] or b"."

    draft = CompressionModel(build(content[1]), build(content[0]), (0.0, 0.0, 0.0), level, chunk)
    good, bad = draft.compressors()
    x = np.array([draft.measure(t, good, bad) for t, _ in held])
    y = np.array([v for _, v in held], float)
    w = fit_logistic(x, y, ridge=1e-6) if len(y) else np.zeros(3)
    return CompressionModel(draft.good, draft.bad, (float(w[0]), float(w[1]), float(w[2]) + prior_shift(counts, y)), level, chunk)


def score_quality(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id, size_difference, score of every row; a null text counts as empty. Other columns are dropped."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = model.compressors()
        for b in batches:
            x = np.array([model.measure(t.as_py(), good, bad) for t in b.column(1)], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x[:, 0]), pa.array(model.score(x))], ["doc_id", "size_difference", "score"])

    return rows.mapInArrow(run, "doc_id long, size_difference double, score double")


def quality_score(model: CompressionModel):
    """A column function: the score of a text column."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad = model.compressors()
        for t in texts:
            x = np.array([model.measure(v, good, bad) for v in t], float).reshape(-1, 2)
            yield pd.Series(model.score(x))

    return score


def train_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, per_class: int = 3000, max_chars: int = 8000) -> CompressionModel:
    """Fits on at most 2 * `per_class` labelled rows of at most `max_chars` characters, none from the held-out fold."""
    return fit_compression_model(*labelled_sample(docs, labels, "quality", modulus, held_out, per_class, max_chars))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score (higher: better), predicted (1 if score >= `threshold`), size_difference.

    One row per input row, repeated ids included; empty and null texts score what a size difference of 0
    scores; an empty table gives no rows; columns besides doc_id and text are ignored.
    """
    scored = score_quality(docs, train_quality(docs, labels, modulus, held_out))
    return scored.select(
        "doc_id",
        in_fold(F.col("doc_id"), modulus, held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "size_difference",
    )
