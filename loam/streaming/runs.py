"""Starting streams and reading back what they wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.session import scratch
from loam.streaming.snapshots import Snapshots, upserts

TRIGGER_SECONDS = 5


def start(stream, checkpoint: str, every: str | None = f"{TRIGGER_SECONDS} seconds"):
    """Start a writer on a time trigger, or over what is there now when `every` is None."""
    timed = stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)
    return timed.option("checkpointLocation", checkpoint).start()


def commit_id(batch: DataFrame, batch_id: int) -> str:
    """Name of a micro-batch: equal when it is repeated, different for another query."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{query or 'batch'}-{batch_id}"


def changelog(path: str) -> Callable[[DataFrame, int], None]:
    """Sink for update-mode rows: each micro-batch owns one partition and may be repeated."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("_batch", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_batch").parquet(path))
    return write


def append_now(rows: DataFrame, purpose: str) -> DataFrame:
    """Run an append-mode stream over what is there now; returns the table it wrote."""
    spark = rows.sparkSession
    root = scratch(spark, purpose)
    start(rows.writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows"),
          f"{root}/checkpoint", None).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/rows")


def update_now(rows: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    """Run an update-mode stream over what is there now; returns the newest row per key."""
    root = scratch(rows.sparkSession, purpose)
    table = Snapshots(rows.sparkSession, f"{root}/rows", rows.schema, keys)
    writer = rows.writeStream.foreachBatch(upserts(table)).outputMode("update")
    start(writer, f"{root}/checkpoint", None).awaitTermination()
    return table.read()
