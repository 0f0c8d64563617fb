"""Sliding and trailing windows over pre-aggregated time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_counts(frame: DataFrame, ts: str, keys: list[str],
                   window_s: int = 300, slide_s: int = 15) -> DataFrame:
    """Rows per (sliding window, keys).

    Rows are counted once per slide-wide pane before anything is shuffled; only
    pane counts, never input rows, are copied into the windows that cover them.
    """
    if window_s % slide_s:
        raise ValueError("the window must be a whole number of slides")
    pane = F.floor(F.unix_seconds(F.col(ts)) / slide_s) * slide_s
    panes = frame.groupBy(*keys, pane.alias("_pane")).agg(F.count(F.lit(1)).alias("_n"))
    first = F.col("_pane") - (window_s - slide_s)
    starts = F.explode(F.sequence(first, F.col("_pane"), F.lit(slide_s).cast("long")))
    return (panes.select(*keys, "_n", starts.alias("_start"))
            .groupBy(*keys, "_start").agg(F.sum("_n").alias("event_count"))
            .select(F.timestamp_seconds("_start").alias("window_start"),
                    F.timestamp_seconds(F.col("_start") + window_s).alias("window_end"),
                    *keys, "event_count"))


def trailing_stats(frame: DataFrame, ts: str, keys: list[str], value: str,
                   span_s: int = 86400) -> DataFrame:
    """Min, max and mean of the last `span_s` seconds at every second that has a row.

    Rows are first reduced to one per key and second, so a window task holds at
    most two spans of seconds of one key however many rows the key has.
    """
    second = F.unix_seconds(F.col(ts))
    grid = frame.groupBy(*keys, second.alias("second")).agg(
        F.min(value).alias("_min"), F.max(value).alias("_max"),
        F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    home = F.floor(F.col("second") / span_s)
    # Each second is needed by its own span and as history of the next one.
    spread = grid.select("*", home.alias("_home"),
                         F.explode(F.array(home, home + 1)).alias("_span"))
    trail = (Window.partitionBy(*keys, "_span").orderBy("second")
             .rangeBetween(-span_s, Window.currentRow))
    return (spread
            .select(*keys, "second", "_home", "_span",
                    F.min("_min").over(trail).alias("min_value"),
                    F.max("_max").over(trail).alias("max_value"),
                    (F.sum("_sum").over(trail) / F.sum("_n").over(trail)).alias("avg_value"))
            .filter(F.col("_home") == F.col("_span")).drop("_home", "_span"))


def with_trailing_stats(frame: DataFrame, ts: str, keys: list[str], value: str,
                        span_s: int = 86400) -> DataFrame:
    stats = trailing_stats(frame, ts, keys, value, span_s)
    rows = frame.withColumn("second", F.unix_seconds(F.col(ts)))
    return rows.join(stats, [*keys, "second"], "left").drop("second")


def since(column: Column, now: str, days: float) -> Column:
    """True for times not older than `days` before `now`; folds to one literal bound."""
    bound = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                              F.lit(days * 86400.0))
    return column >= bound
