"""Bars inside spans of varying length, without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_within(bars: DataFrame, spans: DataFrame, by: list[str], at: str, first: str, last: str, bucket: int = 128) -> DataFrame:
    """Each span's columns with those of every bar whose `at` lies in [first, last] and whose key is the span's.

    Both sides meet by key and bucket of `bucket` places, so a long span is spread over tasks and no bar meets a span that is
    not within one bucket of it. Spans may overlap. Names besides the keys must differ between the two sides.
    """
    own = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(first) / bucket), F.floor(F.col(last) / bucket)))).where(F.col(first) <= F.col(last))
    placed = bars.withColumn("_bucket", F.floor(F.col(at) / bucket))
    return own.join(placed, [*by, "_bucket"]).where(F.col(at).between(F.col(first), F.col(last))).drop("_bucket")
