"""The driver tables re-shaped as sensor-platform frames.

Each binding is a list of expressions both engines read the same way, so one
definition serves the Spark frame and the SQL the results are compared with.
`BROKEN_*` expressions damage some messages on purpose; no row is left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.session import configure
from loam.sources.streams import file_stream
from loam.sources.tables import parquet_table

NOW = "2024-01-31 00:00:00"
LEDGER_NOW = "2001-08-02 00:00:00"
# Files one micro-batch may take, so that its size does not grow with the table.
FILES_PER_TRIGGER = 64

_TYPE = ("CASE event_type WHEN 'view' THEN 'soil_moisture' WHEN 'click' THEN 'CO2_Sensor' "
         "WHEN 'purchase' THEN 'weather_station' WHEN 'signup' THEN 'temp_sensor' ELSE 'other' END")
_BLOCK = ("CASE event_type WHEN 'view' THEN 'soil_metrics' WHEN 'click' THEN 'air_quality' "
          "WHEN 'purchase' THEN 'weather_data' WHEN 'signup' THEN 'temperature_data' "
          "ELSE 'pollution_metrics' END")

READINGS = [
    "event_id", "event_id % 2 AS kafka_partition",
    "CAST(floor(event_id / 2) AS BIGINT) AS kafka_offset",
    "concat('iot.', CAST(user_id % 7 AS STRING), '.s-', CAST(user_id AS STRING)) AS raw_topic",
    "CAST(user_id % 7 AS STRING) AS tenant_id",
    "concat('f-', CAST(user_id % 20 AS STRING)) AS farm_id",
    "concat('s-', CAST(user_id AS STRING)) AS sensor_id",
    "concat('d-', CAST(user_id AS STRING)) AS device_id",
    f"{_TYPE} AS sensor_type", "ts AS event_time", "value", "props AS metrics",
    "CAST(floor(value * 1000) AS BIGINT) AS increment",
]

SENSORS = [
    "concat('s-', CAST(c_custkey AS STRING)) AS sensor_id",
    "CAST(c_nationkey AS STRING) AS tenant_id",
    "concat('f-', CAST(c_custkey % 20 AS STRING)) AS farm_id",
    "CASE WHEN c_custkey % 4 = 0 THEN concat('f-', CAST(c_custkey % 30 AS STRING)) END AS metadata_farm_id",
    "c_name AS sensor_name", "lower(c_mktsegment) AS sensor_type",
    "CASE WHEN c_acctbal < 0 THEN 'error' WHEN c_acctbal < 1000 THEN 'inactive' ELSE 'active' END AS status",
    "(c_custkey * 37) % 100000 AS message_count",
    "CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey * 1000 END AS storage_bytes",
    "CASE WHEN c_acctbal >= 5000 THEN NULL ELSE abs(c_acctbal) / 200 END AS budget",
    "c_acctbal AS balance",
    "CASE WHEN c_custkey % 5 > 0 THEN concat('Field ', CAST(c_custkey % 90 AS STRING)) END AS location",
]

LEDGER = [
    "o_orderkey AS id", "o_custkey % 25 AS billing_id",
    "CASE o_orderstatus WHEN 'F' THEN 'debit' WHEN 'O' THEN 'usage' ELSE 'credit' END AS type",
    "concat(CASE o_orderstatus WHEN 'F' THEN 'CYCLE-' WHEN 'O' THEN 'QRY-' ELSE 'TXN-' END, "
    "CAST(o_orderkey AS STRING)) AS reference",
    "round(o_totalprice / 10000, 6) AS amount", "o_orderkey % 50 AS data_points",
    "concat('Query on S-', CAST(o_custkey AS STRING), ' [', o_orderpriority, ']', "
    "CASE WHEN o_orderkey % 8 = 0 THEN concat(' farm F-', CAST(o_custkey % 20 AS STRING)) ELSE '' END) "
    "AS description",
    "concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) "
    "AS usage_period",
    "o_orderdate AS created_at",
]

BILLINGS = [
    "c_custkey AS billing_id", "CAST(c_nationkey AS STRING) AS tenant_id",
    "CASE WHEN c_acctbal < 0 THEN 'suspended' ELSE 'active' END AS status",
    "CASE c_custkey % 6 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' "
    "WHEN 3 THEN 'quarterly' WHEN 4 THEN 'yearly' ELSE 'never' END AS frequency",
    "c_acctbal AS balance", "round((c_custkey % 1000) * 7.35e0, 2) AS amount_due",
    "(c_custkey * 37) % 100000 AS message_count", "c_custkey % 4 AS sensor_count",
    "CAST(CAST('2023-12-01' AS DATE) + CAST(c_custkey % 90 AS INT) AS TIMESTAMP) AS due_date",
]

QUERY_STATS = [
    "l_orderkey * 10 + l_linenumber AS query_id", "CAST(l_suppkey % 7 AS STRING) AS tenant_id",
    "l_partkey % 10 AS user_id",
    "CAST(floor(l_extendedprice * 100000) AS BIGINT) AS processed_bytes",
    "CAST(floor(l_quantity * 10) AS BIGINT) AS cpu_ms",
    "l_partkey * 1048576 AS peak_mem_bytes",
    "CAST(floor(l_quantity * 200) AS BIGINT) AS wall_ms", "l_shipdate AS run_at",
    "concat('SELECT * FROM part WHERE p_partkey = ', CAST(l_partkey AS STRING)) AS sql",
]

FARMS = [
    "concat('f-', CAST(s_suppkey AS STRING)) AS farm_id", "CAST(s_nationkey AS STRING) AS tenant_id",
    "s_name AS farm_name", "abs(s_acctbal) / 100 AS farm_size_ha",
    "CASE WHEN s_suppkey % 4 > 0 THEN concat(CAST(s_suppkey AS STRING), ' Mill Road') ELSE '' END AS address",
    "CASE WHEN s_suppkey % 3 > 0 THEN concat('Country ', CAST(s_nationkey AS STRING)) END AS country",
]
# The crops of a farm: one of the lists, chosen by its key.
FARM_CROPS = "CASE s_suppkey % 4 " \
    "WHEN 0 THEN array('Maize', 'lettuce', 'Cassava', 'tomato', 'Dragonfruit') " \
    "WHEN 1 THEN array('maize', 'Cocoa') WHEN 2 THEN array('Yam', 'Rice', 'Cotton', 'onion') " \
    "ELSE array('Sweet Potato') END AS crops"

CROPS = [
    "p_partkey AS crop_id", "concat('f-', CAST(p_partkey % 110 AS STRING)) AS farm_id",
    "CASE p_type WHEN 'ECONOMY' THEN 'Maize' WHEN 'SMALL' THEN 'lettuce' WHEN 'STANDARD' THEN 'Cassava' "
    "WHEN 'LARGE' THEN 'tomato' ELSE 'Dragonfruit' END AS crop_name",
    "CAST('2024-01-01' AS DATE) + p_size AS expected_harvest_date", "p_retailprice AS area_ha",
]

ALLOCATIONS = [
    "concat('s-', CAST(s_suppkey % 80 AS STRING)) AS sensor_id", "s_suppkey AS storage_id",
    "(s_suppkey % 80) / 100000e0 AS allocated_gb",
]

USERS = [
    "c_custkey AS user_id", "CAST(c_nationkey AS STRING) AS tenant_id",
    "concat(lower(c_name), '@x.org') AS email",
    "CASE WHEN c_custkey % 2 = 1 THEN concat('N', CAST(c_custkey % 97 AS STRING)) END AS first_name",
]

# Registry change feed.
CHANGES = [
    "event_id AS change_id", "concat('s-', CAST(user_id AS STRING)) AS sensor_id",
    "CAST(user_id % 7 AS STRING) AS tenant_id", "ts AS changed_at",
    "CASE WHEN event_id % 40 = 39 THEN 'delete' ELSE 'upsert' END AS op",
    "CASE WHEN event_id % 40 = 39 THEN NULL ELSE concat('probe-', CAST(CAST(floor(value / 40) AS INT) AS STRING)) END "
    "AS sensor_name",
    "CASE WHEN event_id % 40 = 39 THEN NULL WHEN event_type IN ('view', 'click', 'purchase') THEN 'active' "
    "ELSE 'inactive' END AS status",
    "user_id AS performed_by",
]

# Account events of one billing epoch: counters and query charges only.
EPOCH_EVENTS = [
    "CAST(o_custkey % 25 AS STRING) AS tenant_id", "o_orderdate AS happened_at", "o_orderkey AS id",
    "CASE o_orderstatus WHEN 'F' THEN 'messages' WHEN 'O' THEN 'query' ELSE 'sensors' END AS kind",
    "CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 50) * 1000 ELSE 0 END AS messages",
    "CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END ELSE 0 END "
    "AS sensors",
    "CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice * 10) / 1e6 ELSE 0.0e0 END AS cost",
]

# Account events with top-ups and cycle ends.
ACCOUNT_EVENTS = [
    "CAST(o_custkey % 25 AS STRING) AS tenant_id", "o_orderdate AS happened_at", "o_orderkey AS id",
    "CASE o_orderstatus WHEN 'F' THEN 'messages' WHEN 'O' THEN 'query' ELSE "
    "CASE o_orderkey % 8 WHEN 0 THEN 'topup' WHEN 1 THEN 'cycle' ELSE 'sensors' END END AS kind",
    "CAST(CASE o_orderstatus WHEN 'F' THEN (o_orderkey % 50) * 1000 WHEN 'O' THEN 0 ELSE "
    "CASE WHEN o_orderkey % 8 > 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END ELSE 0 END END AS BIGINT) "
    "AS quantity",
    "CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice * 10) / 1e6 "
    "WHEN o_orderstatus <> 'F' AND o_orderkey % 8 = 0 THEN round(o_totalprice / 200) / 1e2 ELSE 0.0e0 END AS amount",
]

BROKEN_TOPIC = ("CASE WHEN event_id % 89 = 0 THEN 'iot.7' WHEN event_id % 83 = 0 THEN 'iot.a.b.c' "
                "ELSE concat('iot.', CAST(user_id % 7 AS STRING), '.s-', CAST(user_id AS STRING)) END")
BROKEN_JSON = "event_id % 97 = 0"
_STAMP = {"spark": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
          "duckdb": "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"}


def _message(engine: str) -> str:
    digit = "CAST(user_id % 7 AS STRING)"
    sensor = "CAST(user_id AS STRING)"
    parts = [
        "'{\"device_id\":\"d-'", sensor, "'\",\"timestamp\":\"'", _STAMP[engine],
        "'\",\"tenant_id\":\"'", digit, "'\",\"farm_id\":\"f-'", "CAST(user_id % 20 AS STRING)",
        "'\",\"sensor_id\":\"s-'", sensor, "'\",\"sensor_type\":\"'", _TYPE,
        "'\",\"location\":{\"latitude\":'", "CAST(user_id % 90 AS STRING)",
        "',\"longitude\":3},\"'", _BLOCK, "'\":'", "props",
        "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(',\"hardware_info\":{\"firmware_version\":\"v',"
        " CAST(event_id % 9 AS STRING), '\",\"battery_level_percent\":', CAST(event_id % 100 AS STRING),"
        " ',\"memory_free_mb\":', CAST(event_id % 64 AS STRING), ',\"memory_total_mb\":128}') END",
        "'}'",
    ]
    return f"CASE WHEN {BROKEN_JSON} THEN 'not json' ELSE concat({', '.join(parts)}) END"


def _messages(engine: str) -> list[str]:
    return ["event_id", f"{BROKEN_TOPIC} AS topic", f"{_message(engine)} AS value",
            "CAST(event_id % 2 AS INT) AS partition",
            "CAST(floor(event_id / 2) AS BIGINT) AS \"offset\"".replace(
                '"', "`" if engine == "spark" else '"'),
            "ts AS timestamp"]


_SOURCES = {
    "readings": ("events", READINGS), "sensors": ("customer", SENSORS),
    "ledger": ("orders", LEDGER), "billings": ("customer", BILLINGS),
    "query_stats": ("lineitem", QUERY_STATS), "crops": ("part", CROPS),
    "allocations": ("supplier", ALLOCATIONS), "users": ("customer", USERS),
    "changes": ("events", CHANGES), "epoch_events": ("orders", EPOCH_EVENTS),
    "account_events": ("orders", ACCOUNT_EVENTS),
}
_TIMES = {"readings": ["event_time"], "ledger": ["created_at"], "query_stats": ["run_at"],
          "changes": ["changed_at"], "epoch_events": ["happened_at"], "account_events": ["happened_at"],
          "messages": ["timestamp"], "samples": ["ts"]}


class Tables:
    """Bound frames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def table(self, name: str) -> DataFrame:
        return parquet_table(self.spark, self.folder, name)

    def stream(self, name: str) -> DataFrame:
        """A driver table as a file stream. The trailing pattern also matches a folder of files."""
        path = f"{self.folder}/{name}.parquet"
        return file_stream(self.spark, path + "*", self.spark.read.parquet(path).schema,
                           files_per_trigger=FILES_PER_TRIGGER)

    def bind(self, name: str, raw: DataFrame) -> DataFrame:
        if name == "messages":
            frame = raw.selectExpr(*_messages("spark"))
        else:
            frame = raw.selectExpr(*_SOURCES[name][1])
        for column in _TIMES.get(name, []):
            frame = frame.withColumn(column, F.col(column).cast("timestamp"))
        return frame

    def streamed(self, name: str) -> DataFrame:
        source = "events" if name == "messages" else _SOURCES[name][0]
        return self.bind(name, self.stream(source))

    def __getattr__(self, name: str) -> DataFrame:
        if name in _SOURCES:
            return self.bind(name, self.table(_SOURCES[name][0]))
        raise AttributeError(name)

    @property
    def messages(self) -> DataFrame:
        return self.bind("messages", self.table("events"))

    @property
    def farms(self) -> DataFrame:
        return self.table("supplier").selectExpr(*FARMS, FARM_CROPS)

    @property
    def live(self) -> DataFrame:
        """Messages that came in per sensor."""
        return self.readings.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("message_count"))

    @property
    def routes(self) -> DataFrame:
        topics = self.readings.filter("tenant_id <> '6'").select("raw_topic").distinct()
        return topics.select(F.replace("raw_topic", F.lit("."), F.lit("/")).alias("path"),
                             F.col("raw_topic").alias("target"))

    @property
    def balances(self) -> DataFrame:
        tenant = (F.col("o_custkey") % 25)
        return (self.table("orders").select(tenant.alias("t")).distinct()
                .select(F.col("t").cast("string").alias("tenant_id"),
                        ((F.col("t") + 1) * 4.0).alias("balance")))

    @property
    def subscriptions(self) -> DataFrame:
        tenant = (F.col("o_custkey") % 25)
        return (self.table("orders").select(tenant.alias("t")).distinct()
                .select(F.col("t").cast("string").alias("tenant_id"),
                        ((F.col("t") % 3) * 1.5).alias("subscription_cost")))

    @property
    def samples(self) -> DataFrame:
        """Hourly counter and lag samples per topic and partition."""
        from pyspark.sql import Window
        hourly = (self.table("events")
                  .groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp").alias("ts"),
                           F.col("event_type").alias("topic"),
                           (F.col("event_id") % 2).alias("kafka_partition"))
                  .agg(F.count(F.lit(1)).alias("n")))
        series = Window.partitionBy("topic", "kafka_partition").orderBy("ts")
        return hourly.select("ts", "topic", "kafka_partition",
                             (F.col("n") * 400).alias("consumer_lag"),
                             F.sum("n").over(series).alias("messages_in_total"))


def _select(name: str) -> str:
    table, expressions = _SOURCES[name]
    return f"SELECT {', '.join(expressions)} FROM {table}"


_CTES = {name: _select(name) for name in _SOURCES}
_CTES["messages"] = f"SELECT {', '.join(_messages('duckdb'))} FROM events"
_CTES["farms"] = f"SELECT {', '.join(FARMS)}, {FARM_CROPS} FROM supplier".replace("array(", "list_value(")
_CTES["live"] = "SELECT sensor_id, count(*) AS message_count FROM readings GROUP BY sensor_id"
_CTES["routes"] = ("SELECT DISTINCT replace(raw_topic, '.', '/') AS path, raw_topic AS target "
                   "FROM readings WHERE tenant_id <> '6'")
_CTES["balances"] = ("SELECT DISTINCT CAST(o_custkey % 25 AS STRING) AS tenant_id, "
                     "(o_custkey % 25 + 1) * 4.0::DOUBLE AS balance FROM orders")
_CTES["subscriptions"] = ("SELECT DISTINCT CAST(o_custkey % 25 AS STRING) AS tenant_id, "
                          "(o_custkey % 25 % 3) * 1.5::DOUBLE AS subscription_cost FROM orders")
_CTES["samples"] = """
SELECT h AS ts, topic, kafka_partition, n * 400 AS consumer_lag,
  CAST(sum(n) OVER (PARTITION BY topic, kafka_partition ORDER BY h
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS messages_in_total
FROM (SELECT date_trunc('hour', ts) AS h, event_type AS topic, event_id % 2 AS kafka_partition,
      count(*) AS n FROM events GROUP BY 1, 2, 3) x"""
_NEEDS = {"live": ["readings"], "routes": ["readings"]}


def oracle(body: str) -> str:
    """Comparison SQL with the bindings it names put in front."""
    body = body.strip()
    named = [n for n in _CTES if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", body, re.I)]
    wanted: list[str] = []
    for name in named:
        wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    if not wanted:
        return body
    head = ", ".join(f"{name} AS ({_CTES[name].strip()})" for name in wanted)
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if own:
        return f"WITH {own.group(1) or ''}{head}, {body[own.end():]}"
    return f"WITH {head} {body}"
