"""Windowed counts of timed rows, alike for finished tables and streams.

An addition: the domain itself has finished files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], value: str, width: str, late: str | None = None) -> DataFrame:
    """(start, keys, n, total) by window; ``late`` sets the watermark that a stream needs to append and to drop state."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")
