"""Billing states kept up by a stream, whatever the batches and the order of arrival.

The order of events decides when a billing is suspended and which amount is frozen, and a
feed may deliver them late. So the stream only keeps the events, each micro-batch in a
partition of its own that a repeated batch replaces; a state is the history form over all
events kept so far. An event that comes late changes the states from then on as if it had
come in time; one that comes twice counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.account_history import account_states
from loam.schemas import PRICES, Prices
from loam.streaming import runs

EVENT = ["tenant_id", "happened_at", "id", "kind", "quantity", "amount"]


def record_events(events: DataFrame, path: str, checkpoint: str, every: str | None = "5 seconds"):
    """Starts the stream that keeps account events below `path`."""
    return runs.start(events.select(*EVENT).writeStream.foreachBatch(runs.changelog(path)), checkpoint, every)


def billing_states(spark: SparkSession, path: str, prices: Prices = PRICES) -> DataFrame:
    """State of every tenant after the events kept so far."""
    kept = spark.read.parquet(path).drop("_batch").dropDuplicates(["tenant_id", "id"])
    return account_states(kept.withColumn("happened_at", F.col("happened_at").cast("timestamp")), prices)
