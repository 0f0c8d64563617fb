"""Event-time windows over the reading stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WATERMARK, WINDOW, SLIDE = "10 minutes", "5 minutes", "15 seconds"


def sliding_counts(readings: DataFrame, keys: list[str], watermark: str = WATERMARK,
                   window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """Readings per sliding window, updated with every micro-batch (update mode).

    Rows older than the watermark are dropped by the engine.
    """
    return _named(readings.withWatermark("event_time", watermark)
                  .groupBy(F.window("event_time", window, slide).alias("w"), *keys)
                  .agg(F.count(F.lit(1)).alias("event_count")), keys)


def closed_sliding_counts(readings: DataFrame, keys: list[str], watermark: str = WATERMARK,
                          window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """Readings per sliding window, once the watermark has passed it (append mode).

    Readings are counted per slide-wide pane first, and only pane counts enter the windows
    that cover them, so a row is never copied. A row is late once the watermark has passed
    the end of its pane.
    """
    panes = (readings.withWatermark("event_time", watermark)
             .groupBy(F.window("event_time", slide).alias("pane"), *keys)
             .agg(F.count(F.lit(1)).alias("n")))
    return _named(panes.groupBy(F.window(F.window_time("pane"), window, slide).alias("w"), *keys)
                  .agg(F.sum("n").alias("event_count")), keys)


def _named(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "event_count")
