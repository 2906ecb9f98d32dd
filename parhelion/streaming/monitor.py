"""The window monitor as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_windows(events: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, n, label_rate of tumbling windows; state older than the watermark is dropped."""
    by = events.withWatermark(ts, late).groupBy(F.window(ts, width))
    return by.agg(F.count("*").alias("n"), F.avg(F.col("y_pu").cast("double")).alias("label_rate")).select(F.col("window.start").alias("start"), "n", "label_rate")
