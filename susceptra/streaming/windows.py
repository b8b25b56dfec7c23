"""Windowed counts of a stream whose windows close, are written once, and leave the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, kind: str, at: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """A stream of events -> (kind, start, n) of each window, once the newest event is `late` beyond its end.

    Append output: a window that was written is forgotten, so the state holds only what is still open, whatever the
    stream's length. Events that come later than that are dropped, as no window is open for them.
    """
    timed = events.select(kind, F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    counts = timed.groupBy(kind, F.window("at", every).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(kind, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
