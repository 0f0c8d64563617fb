"""Sources, sinks and table management."""

from pyspark.sql import functions as F

from loam import schemas
from loam.catalogue import query
from loam.catalogue.aggregates import windowed
from loam.functions import envelope as E
from loam.operators import readings
from loam.session import scratch
from loam.sources import avro, lake, streams, tables
from loam.streaming import counters, ingest, runs, windows


@query("src1_topic_pattern_stream", "SELECT topic, count(*) AS n FROM messages GROUP BY topic")
def topic_pattern_stream(t):
    matched = t.streamed("messages").filter(F.col("topic").rlike(streams.SENSOR_TOPICS))
    written = runs.append_now(matched.select(*streams.MESSAGE_COLUMNS), "src1")
    return written.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("src2_single_topic_stream", """
SELECT 'raw-sensor-data' AS topic, partition, count(*) AS n, max("offset") AS last_offset FROM messages GROUP BY partition""")
def single_topic_stream(t):
    raw = t.streamed("messages").withColumn("topic", F.lit(streams.RAW_TOPIC))
    written = runs.append_now(raw.select("topic", "partition", "offset"), "src2")
    return written.groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("n"), F.max("offset").alias("last_offset"))


@query("src3_topic_table", """
SELECT topic, partition, count(*) AS n, min("offset") AS first_offset, max("offset") AS last_offset,
  CAST(sum(length(value)) AS BIGINT) AS bytes FROM messages GROUP BY 1, 2""")
def topic_table(t):
    return t.messages.groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("n"), F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"), F.sum(F.length("value")).alias("bytes"))


@query("src4_log_tail", """
SELECT topic, partition, "offset" FROM messages
QUALIFY row_number() OVER (PARTITION BY topic, partition ORDER BY "offset" DESC) <= 10""")
def log_tail(t):
    return readings.log_tail(t.messages).select("topic", "partition", "offset")


@query("src5_live_lines", 'SELECT topic, partition, "offset", value AS payload FROM messages')
def live_lines(t):
    lines = runs.append_now(counters.live_lines(t.streamed("messages")), "src5")
    return lines.select("topic", F.get_json_object("line", "$.partition").cast("int").alias("partition"),
                        F.get_json_object("line", "$.offset").cast("long").alias("offset"),
                        F.get_json_object("line", "$.payload").alias("payload"))


@query("src6_dimension_scan", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def dimension_scan(t):
    return tables.parquet_table(t.spark, t.folder, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query("src7_reference_tables", """
SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation
UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier
UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def reference_tables(t):
    counts = [t.table(name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
              for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionByName(part)
    return result


LEGACY_RECORD = """{"type": "record", "name": "soil_moisture", "fields": [
  {"name": "farm_id", "type": "string"},
  {"name": "timestamp", "type": {"type": "long", "logicalType": "timestamp-millis"}},
  {"name": "moisture", "type": "float"}, {"name": "ph", "type": ["null", "float"]}]}"""


@query("src8_registry_record", """
SELECT farm_id, count(*) AS n, date_trunc('millisecond', max(event_time)) AS last_at,
  round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 3) AS moisture, CAST(count(*) FILTER (event_id % 4 = 0) AS BIGINT) AS with_ph
FROM readings GROUP BY farm_id""")
def registry_record(t):
    record = F.to_json(F.struct(
        "farm_id", F.unix_millis("event_time").alias("timestamp"), F.col("value").alias("moisture"),
        F.when(F.col("event_id") % 4 == 0, F.lit(6.5)).alias("ph")))
    rows = t.readings.select(avro.decode(record, LEGACY_RECORD).alias("r")).select("r.*")
    return rows.groupBy("farm_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_at"),
        F.round(F.sum(F.col("moisture").cast("double")), 3).alias("moisture"),
        F.count("ph").alias("with_ph"))


def new_lake(t, purpose):
    root = scratch(t.spark, purpose)
    return lake.Lake(t.spark, "loam_" + root.rsplit("-", 1)[1], root).create()


def ingested(t, purpose):
    """A fresh lake filled by the ingest stream."""
    target = new_lake(t, purpose)
    ingest.ingest(t.streamed("messages"), target, scratch(t.spark, purpose + "-state"), None).awaitTermination()
    return target


_ACCEPTED = """FROM events e JOIN messages m ON e.event_id = m.event_id
WHERE m.value <> 'not json' AND m.topic NOT IN ('iot.7', 'iot.a.b.c')"""
_TYPE = """CASE e.event_type WHEN 'view' THEN 'soil' WHEN 'click' THEN 'co2' WHEN 'purchase' THEN 'weather'
  WHEN 'signup' THEN 'temperature' ELSE 'unknown' END"""


@query("snk1_lake_tables", f"""
SELECT {_TYPE} AS sensor_type, CAST(e.user_id % 7 AS STRING) AS tenant_id, CAST(CAST(e.ts AS DATE) AS STRING) AS day,
  count(*) AS n, CAST(sum(m."offset") AS BIGINT) AS offsets {_ACCEPTED} GROUP BY 1, 2, 3""")
def lake_tables(t):
    rows = t.spark.table(ingested(t, "snk1").readings)
    return rows.groupBy("sensor_type", "tenant_id", F.col("event_date").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_offset").alias("offsets"))


_CLOSED = """WHERE window_end <= (SELECT date_trunc('millisecond', max(event_time)) FROM readings) - INTERVAL 10 MINUTE"""


@query("snk2_bronze_counts", f"SELECT * FROM ({windowed('farm_id, sensor_type')}) w {_CLOSED}")
def bronze_counts(t):
    return runs.append_now(windows.closed_sliding_counts(t.streamed("readings"), ["farm_id", "sensor_type"]), "snk2")


@query("snk3_routed_stream", """
SELECT r.target AS topic, replace(m.topic, '.', '/') AS key, count(*) AS n FROM messages m
JOIN routes r ON replace(m.topic, '.', '/') = r.path GROUP BY 1, 2""")
def routed_stream(t):
    messages = t.streamed("messages").withColumn("path", F.replace("topic", F.lit("."), F.lit("/"))).drop("topic")
    sent = runs.append_now(counters.route(messages, t.routes), "snk3")
    return sent.groupBy("topic", "key").agg(F.count(F.lit(1)).alias("n"))


@query("ddl1_type_views", f"""
SELECT concat(k.name, '_data') AS view_name, count(x.t) AS n FROM (
  SELECT unnest(['soil', 'co2', 'weather', 'temperature', 'environment', 'humidity', 'pressure', 'light', 'flow',
    'unknown']) AS name) k LEFT JOIN (SELECT {_TYPE} AS t {_ACCEPTED}) x ON k.name = x.t GROUP BY 1""")
def type_views(t):
    target = ingested(t, "ddl1").create()
    result = None
    for kind in [*schemas.METRIC_BLOCKS, schemas.UNKNOWN_TYPE]:
        name = f"{kind}_data"
        counted = t.spark.table(f"{target.database}.{name}").agg(
            F.lit(name).alias("view_name"), F.count(F.lit(1)).alias("n"))
        result = counted if result is None else result.unionByName(counted)
    return result


@query("ddl2_added_column", """
SELECT sensor_id, count(*) AS n, count(CASE WHEN event_time >= TIMESTAMP '2024-01-16' THEN farm_id END) AS with_farm
FROM readings GROUP BY sensor_id""")
def added_column(t):
    """Files written before farm_id existed are read beside newer ones."""
    root = scratch(t.spark, "ddl2")
    split = F.col("event_time") >= F.lit("2024-01-16").cast("timestamp")
    t.readings.filter(~split).drop("farm_id").write.parquet(f"{root}/part=1")
    t.readings.filter(split).write.parquet(f"{root}/part=2")
    merged = t.spark.read.option("mergeSchema", "true").parquet(root)
    return merged.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"), F.count("farm_id").alias("with_farm"))


@query("ddl4_retention", """
SELECT event_id, event_time FROM readings WHERE event_time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""")
def retention(t):
    return lake.retained(t.readings, "2024-01-31 00:00:00").select("event_id", "event_time")


@query("ddl4_expired_partitions", f"""
SELECT CAST(CAST(e.ts AS DATE) AS STRING) AS day, count(*) AS n {_ACCEPTED} AND CAST(e.ts AS DATE) >= DATE '2024-01-24'
GROUP BY 1""")
def expired_partitions(t):
    target = ingested(t, "ddl4")
    target.expire("2024-01-31 00:00:00")
    rows = t.spark.table(target.readings)
    return rows.groupBy(F.col("event_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("ddl5_union_view", f"""
SELECT concat('s-', CAST(e.user_id AS STRING)) AS sensor_id, CAST(e.user_id % 7 AS STRING) AS tenant_id,
  date_trunc('second', e.ts) AS timestamp, CASE WHEN e.event_type <> 'error' THEN replace(e.props, ' ', '') END AS payload
{_ACCEPTED}""")
def union_view(t):
    return t.spark.table(f"{ingested(t, 'ddl5').database}.sensor_data")


@query("udf1_first_field", "SELECT DISTINCT split_part(value, ',', 1) AS first_field FROM messages")
def first_field(t):
    return readings.first_field(t.messages)
