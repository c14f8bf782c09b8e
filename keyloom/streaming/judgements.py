"""Reports over arriving events: windowed counts with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "1 hour", every: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of each window; rows later than `late` are dropped by the watermark. Works on batches too."""
    w = F.window("ts", every)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
