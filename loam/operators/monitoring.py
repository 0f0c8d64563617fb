"""Pipeline health: lag, counter rates, gauges and sustained alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.plans.ordered import Ordered, previous, running_sum


def lag_by_partition(samples: DataFrame) -> DataFrame:
    return samples.groupBy("ts", "topic", "kafka_partition").agg(
        F.sum("consumer_lag").alias("consumer_lag"))


def counter_rate(samples: DataFrame, series: list[str], counter: str, by: list[str],
                 window_s: int) -> DataFrame:
    """Per-second increase of a counter over each window, summed to `by`.

    A counter that falls has been reset, so its new value is the increase. The
    first sample of a series has nothing to compare with and adds nothing.
    """
    stepped = Ordered.of(samples, series, ["ts"]).scan(
        _before=previous(F.col(counter))).result()
    value, before = F.col(counter), F.col("_before")
    increase = F.when(before.isNull(), 0).when(value < before, value).otherwise(value - before)
    end = F.timestamp_seconds(F.ceil(F.unix_seconds("ts") / window_s) * window_s)
    return (stepped.groupBy(*by, end.alias("window_end"))
            .agg((F.sum(increase) / window_s).alias("rate")))


def rates_at_steps(samples: DataFrame, series: list[str], counter: str, by: list[str], ranges_s: list[int], step_s: int) -> DataFrame:
    """Per-second increase of a counter over the last `range_s` seconds at every step, summed to `by`.

    Steps are the multiples of `step_s`; a range takes the samples after its beginning up
    to the step. Resets are corrected in a running total, so the increase within a range is
    the highest total less the lowest. Samples are reduced to one row per series and step
    first, and only these are copied into the ranges that cover them. A series with one
    sample in a range has no rate there.
    """
    if any(r <= 0 or r % step_s for r in ranges_s):
        raise ValueError("a range must be a whole number of steps")
    value, before = F.col(counter), F.col("_before")
    rise = F.when(before.isNull(), 0).when(value < before, value).otherwise(value - before)
    known = samples.filter(value.isNotNull() & F.col("ts").isNotNull())
    total = (Ordered.of(known, series, ["ts"]).scan(_before=previous(value))
             .scan(_total=running_sum(rise)).result())
    pane = F.ceil(F.unix_micros("ts") / (step_s * 1_000_000)) * step_s
    panes = total.groupBy(*series, pane.alias("_pane")).agg(
        F.min("_total").alias("_low"), F.max("_total").alias("_high"), F.count(F.lit(1)).alias("_n"))
    reach = F.explode(F.array(*[F.lit(r).cast("long") for r in ranges_s])).alias("range_s")
    steps = F.explode(F.sequence("_pane", F.col("_pane") + F.col("range_s") - step_s, F.lit(step_s).cast("long"))).alias("_step")
    of_series = (panes.select("*", reach).select("*", steps).groupBy(*series, "range_s", "_step")
                 .agg((F.max("_high") - F.min("_low")).alias("_rise"), F.sum("_n").alias("_n")))
    return (of_series.filter("_n > 1").groupBy(*by, "range_s", F.timestamp_seconds("_step").alias("step"))
            .agg((F.sum("_rise") / F.col("range_s")).alias("rate")))


def gauges(samples: DataFrame, gauge: str) -> DataFrame:
    """Sum and mean of a gauge over the partitions of a topic at every instant."""
    return samples.groupBy("ts", "topic").agg(
        F.sum(gauge).alias("sum_value"), F.avg(gauge).alias("avg_value"),
        F.count_distinct("kafka_partition").alias("partitions"))


def highest_by_partition(samples: DataFrame, gauge: str) -> DataFrame:
    return samples.groupBy("topic", "kafka_partition").agg(F.max(gauge).alias("max_value"))


def sustained_alerts(samples: DataFrame, series: list[str], gauge: str, threshold: float,
                     for_s: int) -> DataFrame:
    """Runs of samples above the threshold that last at least `for_s` seconds."""
    breach = F.col(gauge) > threshold
    runs = Ordered.of(samples, series, ["ts"]).scan(
        _run=running_sum(F.when(breach, 0).otherwise(1))).result()
    spans = runs.filter(breach).groupBy(*series, "_run").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_breach_at"),
        F.count(F.lit(1)).alias("samples"), F.max(gauge).alias("peak"))
    lasted = F.unix_seconds("last_breach_at") - F.unix_seconds("started_at")
    return spans.filter(lasted >= for_s).drop("_run")
