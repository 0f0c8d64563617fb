"""Analytics over sensor readings and raw stream records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam import schemas
from loam.functions import envelope as E
from loam.plans.paging import newest


def parsed(messages: DataFrame) -> DataFrame:
    """Stream records with envelope, keys, type, metrics, calendar and a reject reason.

    One lazy plan for all topics and types; nothing is collected. The payload is
    exploded from a one-element array because no filter is moved below that step:
    a filter on the reject reason would otherwise read the JSON text a second time.
    """
    topic, env = F.col("topic"), F.col("_env")
    read = (messages.withColumn("_json", F.col("value").cast("string"))
            .select("*", F.explode(F.array(E.payload(F.col("_json")))).alias("_env"))
            .withColumn("sensor_type", E.canonical_type(env["sensor_type"]))
            .withColumn("event_time", E.iso_timestamp(env["timestamp"])))
    reason = (F.when(~E.topic_is_valid(topic), "bad_topic")
              .when(~E.payload_is_valid(env), "bad_json"))
    return read.select(
        F.coalesce(E.topic_part(topic, 1), env["tenant_id"]).alias("tenant_id"),
        env["farm_id"].alias("farm_id"),
        F.coalesce(E.topic_part(topic, 2), env["sensor_id"]).alias("sensor_id"),
        env["device_id"].alias("device_id"),
        "event_time", env["location"].alias("location"),
        E.metric_block(env, F.col("sensor_type")).alias("metrics"),
        topic.alias("raw_topic"),
        *[part.alias(name) for name, part in E.calendar_parts(F.col("event_time")).items()],
        # What tells no readable time is kept under the day it came, so that it expires too.
        "sensor_type", F.to_date(F.coalesce("event_time", "timestamp")).alias("event_date"),
        F.col("partition").alias("_partition"), F.col("offset").alias("_offset"),
        F.to_date("timestamp").alias("arrival_date"), F.col("_json").alias("_raw"),
        reason.alias("reject_reason"))


def accepted(parsed_rows: DataFrame) -> DataFrame:
    return parsed_rows.filter(F.col("reject_reason").isNull()).drop("reject_reason", "_raw")


def dead_letters(parsed_rows: DataFrame) -> DataFrame:
    return parsed_rows.filter(F.col("reject_reason").isNotNull()).select(
        "raw_topic", "_partition", "_offset", F.col("_raw").alias("value"), "reject_reason",
        "arrival_date")


def lake_rows(parsed_rows: DataFrame) -> DataFrame:
    return accepted(parsed_rows).select(*[name for name, _ in schemas.LAKE_COLUMNS])


def typed_metrics(rows: DataFrame, sensor_type: str) -> DataFrame:
    """Lake rows of one type with its measurements as columns."""
    block = F.from_json("metrics", schemas.metric_schema(sensor_type))
    return (rows.filter(F.col("sensor_type") == sensor_type)
            .withColumn("_m", block)
            .select("tenant_id", "farm_id", "sensor_id", "event_time", "_m.*"))


def latest_of_sensor(readings: DataFrame, sensor_id: str, tenant_id: str, n: int = 100) -> DataFrame:
    return (readings.filter((F.col("sensor_id") == sensor_id) & (F.col("tenant_id") == tenant_id))
            .orderBy(F.col("event_time").desc(), F.col("event_id").desc()).limit(n))


def newest_of_sensor(spark: SparkSession, table: str, sensor_id: str, tenant_id: str, n: int = 100) -> DataFrame:
    """`latest_of_sensor` of a table partitioned by event_date that reads only its newest days.

    Days are taken newest first, each time twice as many, until they hold `n` readings of
    the sensor, so the files read do not grow with the history. Days come from the catalog.
    Readings without a time come last, so they matter only if there are fewer than `n` others.
    """
    spec = spark.sql(f"SHOW PARTITIONS {table}").select(F.try_to_date(
        F.regexp_extract("partition", r"event_date=([0-9-]{10})", 1)).alias("day"))
    days = [r.day for r in spec.where("day is not null").distinct().orderBy(F.desc("day")).collect()]
    own = spark.table(table).filter((F.col("sensor_id") == sensor_id) & (F.col("tenant_id") == tenant_id))
    timed = own.filter(F.col("event_time").isNotNull())
    taken, step, have = 0, 1, 0
    while taken < len(days) and have < n:
        batch = days[taken:taken + step]
        have += timed.filter(F.col("event_date").between(batch[-1], batch[0])).limit(n).count()
        taken, step = taken + len(batch), step * 2
    if have >= n:
        own = timed.filter(F.col("event_date") >= days[taken - 1])
    return own.orderBy(F.col("event_time").desc(), F.col("event_id").desc()).limit(n)


def latest_per_sensor(events: DataFrame, keys: list[str], order: list[str],
                      columns: list[str]) -> DataFrame:
    """The newest row of each key by a map-side combined maximum, no sort of the input."""
    row = F.max_by(F.struct(*columns), F.struct(*order))
    return events.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*")


def last_messages(readings: DataFrame, n: int = 5) -> DataFrame:
    return newest(readings, ["sensor_id"], [F.col("event_time").desc(), F.col("event_id").desc()], n)


def log_tail(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last `n` records of each partition; the rank limit applies before the shuffle too.

    On Kafka itself read from start offsets instead (`sources.streams.tail_offsets`).
    """
    return newest(messages, ["topic", "partition"], [F.col("offset").desc()], n)


def terminal_lines(messages: DataFrame) -> DataFrame:
    """Stream records as the JSON lines a live terminal shows."""
    line = F.to_json(F.struct("offset", "partition", F.col("timestamp").alias("ts"),
                              F.col("value").cast("string").alias("payload")))
    return messages.select("topic", "partition", "offset", line.alias("line"))


def with_terminal_block(messages: DataFrame) -> DataFrame:
    """The first known measurement block of a payload, else the whole payload."""
    text = F.col("value").cast("string")
    names = [f"_block_{i}" for i, _ in enumerate(schemas.TERMINAL_BLOCKS)]
    found = messages.select("*", F.json_tuple(text, *schemas.TERMINAL_BLOCKS).alias(*names))
    return found.withColumn("metrics", F.coalesce(*names, text)).drop(*names)


def message_counters(readings: DataFrame, increment: str = "increment") -> DataFrame:
    """Per sensor: messages, last arrival and the single activation event."""
    return readings.groupBy("tenant_id", "sensor_id").agg(
        F.sum(increment).alias("message_count"),
        F.max("event_time").alias("last_message_at"),
        F.min("event_time").alias("activated_at"))


def activations(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Pending sensors turn active at their first message, one event each."""
    first = readings.groupBy("sensor_id").agg(
        F.min_by(F.struct("event_time", "event_id", "increment"),
                 F.struct("event_time", "event_id")).alias("_first"))
    # Event name and text of a first message.
    return (sensors.filter(F.col("status") == "pending").join(first, "sensor_id")
            .select("sensor_id", "tenant_id", F.lit("active").alias("status"),
                    F.lit("data_received").alias("event_type"),
                    F.lit("First data message received. Sensor is now active.").alias("message"),
                    F.col("_first.increment").alias("messages"),
                    F.col("_first.event_time").alias("created_at")))


def topic_message_counts(messages: DataFrame) -> DataFrame:
    """Messages ever written per topic (sum of next offsets) and messages still kept."""
    marks = messages.groupBy("topic", "partition").agg(
        (F.max("offset") + 1).alias("_high"), F.min("offset").alias("_low"))
    return marks.groupBy("topic").agg(
        F.sum("_high").alias("message_count"),
        F.sum(F.col("_high") - F.col("_low")).alias("retained_count"))


def latest_hardware(messages: DataFrame, n: int = 10) -> DataFrame:
    """Last hardware_info object among the newest `n` records of each partition, by topic.

    The tail is taken first, so only a few messages are parsed.
    """
    text = F.get_json_object(F.col("value").cast("string"), "$.hardware_info")
    seen = log_tail(messages, n).withColumn("_hw", text)
    rank = F.when(F.col("_hw").startswith("{"), F.struct("timestamp", "partition", "offset"))
    return (seen.groupBy("topic").agg(F.max_by("_hw", rank).alias("_hw"))
            .filter(F.col("_hw").isNotNull())
            .select("topic", F.from_json("_hw", schemas.HARDWARE).alias("_h"))
            .select("topic", "_h.*"))


def distinct_topics(messages: DataFrame) -> DataFrame:
    return messages.select("topic").distinct()


def distinct_types(messages: DataFrame) -> DataFrame:
    """Sensor types that accepted messages of a batch hold."""
    return accepted(parsed(messages)).select("sensor_type").distinct()


def first_field(messages: DataFrame) -> DataFrame:
    """Distinct first comma field of the raw value."""
    field = F.split(F.col("value").cast("string"), ",", 2)[0]
    return messages.select(field.alias("first_field")).distinct()
