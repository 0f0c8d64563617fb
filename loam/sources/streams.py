"""Sensor message sources: Kafka topics, or files of the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.schemas import MESSAGE, TOPIC_NAMESPACE

# Fixed value: how often the ingest job looks for new topics.
TOPIC_REFRESH_MS = "30000"
SENSOR_TOPICS = TOPIC_NAMESPACE + r"\..+"
RAW_TOPIC = "raw-sensor-data"
MESSAGE_COLUMNS = [f.name for f in MESSAGE.fields]


def kafka_stream(spark: SparkSession, servers: str, pattern: str | None = SENSOR_TOPICS,
                 topic: str | None = None, starting: str = "earliest", per_trigger: int | None = None,
                 fail_on_data_loss: bool = True, **options: str) -> DataFrame:
    """Stream of all topics matching a pattern, or of one topic.

    Reads from the first offset without a limit a trigger, and fails where offsets are
    lost, unless told otherwise.
    """
    chosen = {"subscribe": topic} if topic else {"subscribePattern": pattern}
    settings = {"kafka.bootstrap.servers": servers, "kafka.metadata.max.age.ms": TOPIC_REFRESH_MS, "startingOffsets": starting,
                "failOnDataLoss": str(fail_on_data_loss).lower(), **chosen, **options}
    if per_trigger:
        settings["maxOffsetsPerTrigger"] = str(per_trigger)
    return spark.readStream.format("kafka").options(**settings).load().select(*MESSAGE_COLUMNS)


def kafka_table(spark: SparkSession, servers: str, pattern: str = SENSOR_TOPICS,
                starting: str = "earliest", ending: str = "latest", **options: str) -> DataFrame:
    """A bounded range of topic offsets as a table."""
    settings = {"kafka.bootstrap.servers": servers, "subscribePattern": pattern,
                "startingOffsets": starting, "endingOffsets": ending, **options}
    return spark.read.format("kafka").options(**settings).load().select(*MESSAGE_COLUMNS)


def tail_offsets(ends: dict[str, dict[int, int]], n: int = 10) -> str:
    """Start offsets, as the Kafka reader takes them, of the last `n` records of each partition."""
    return json.dumps({topic: {str(p): max(0, end - n) for p, end in parts.items()} for topic, parts in ends.items()})


def file_stream(spark: SparkSession, path: str, schema: T.StructType = MESSAGE,
                fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New files under a folder (or files matching a path) as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def message_stream(spark: SparkSession, kind: str, **where) -> DataFrame:
    """The configured message source; both kinds give the same columns."""
    if kind == "kafka":
        return kafka_stream(spark, **where)
    if kind == "files":
        return file_stream(spark, **where)
    raise ValueError(f"unknown source kind: {kind}")


def publish(rows: DataFrame, servers: str, checkpoint: str, **options: str):
    """Write (topic, key, value) rows back to Kafka; producer settings pass through."""
    return (rows.select("topic", F.col("key").cast("binary"), F.col("value").cast("binary"))
            .writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("checkpointLocation", checkpoint).options(**options).start())
