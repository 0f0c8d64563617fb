"""Running counters, routing and live lines on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import money
from loam.operators.readings import terminal_lines
from loam.schemas import PRICES, Prices


def message_counters(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Messages so far and last arrival per key, for update mode."""
    return readings.groupBy(*keys).agg(F.sum("increment").alias("message_count"),
                                       F.max("event_time").alias("last_message_at"))


CROSSING = "sensor_id string, event_id long, event_time timestamp, messages long, cost double, budget double, status string"


def first_crossings(readings: DataFrame, sensors: DataFrame, prices: Prices = PRICES) -> DataFrame:
    """The reading at which an active sensor's running cost reaches its budget, once per sensor, for append mode.

    Kept for every watched sensor: its messages so far and whether it has crossed; the state
    store carries both through restarts. Readings of one micro-batch are taken in order of
    time and id, micro-batches in order of arrival. Rows with null increments count nothing.
    """
    watched = sensors.filter((F.col("status") == "active") & (F.col("budget") > 0)).select("sensor_id", "budget")
    rows = readings.select("sensor_id", "event_id", "event_time", F.coalesce("increment", F.lit(0)).cast("long").alias("increment")).join(watched, "sensor_id")
    price = prices.message

    def cross(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        messages, crossed = state.get if state.exists else (0, False)
        found = pd.concat(frames, ignore_index=True)
        if crossed:
            return
        found = found.sort_values(["event_time", "event_id"], ignore_index=True)
        upto = messages + found["increment"].cumsum()
        over = (upto * price >= found["budget"]).to_numpy()
        state.update((int(upto.iloc[-1]), bool(over.any())))
        if over.any():
            at = int(over.argmax())
            row = found.iloc[at]
            yield pd.DataFrame({"sensor_id": [key[0]], "event_id": [row["event_id"]], "event_time": [row["event_time"]], "messages": [int(upto[at])],
                                "cost": [upto[at] * price], "budget": [row["budget"]], "status": ["inactive"]})

    return rows.groupBy("sensor_id").applyInPandasWithState(cross, CROSSING, "messages long, crossed boolean", "append", "NoTimeout")


def route(messages: DataFrame, routes: DataFrame) -> DataFrame:
    """Messages with a registered route, keyed by where they came from; the rest is dropped."""
    known = routes.select(F.col("path").alias("_path"), F.col("target").alias("topic"))
    return (messages.join(known, messages["path"] == known["_path"], "inner")
            .select("topic", F.col("path").alias("key"), "value"))


def live_lines(messages: DataFrame) -> DataFrame:
    return terminal_lines(messages)
