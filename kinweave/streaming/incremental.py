"""Marginals kept up to date over a stream of events: windowed counts with a watermark for late rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_marginal(stream: DataFrame, time: str, columns: Sequence[str], every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, the columns and n, over a stream or a table; rows later than the watermark are dropped."""
    held = stream.withWatermark(time, late) if stream.isStreaming else stream
    counts = held.groupBy(F.window(time, every).alias("w"), *columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *columns, "n")


def merged(parts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The marginal over all windows."""
    return parts.groupBy(*columns).agg(F.sum("n").alias("n"))
