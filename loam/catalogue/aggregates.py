"""Aggregations."""

from pyspark.sql import functions as F

from loam import bindings
from loam.catalogue import query
from loam.catalogue.joins import subscriptions
from loam.functions import envelope as E
from loam.operators import billing, farms, metering, monitoring, readings, registry
from loam.plans import panes


# Exact sum of ledger amounts, which have six decimals.
SUM = "CAST(sum(CAST(round(amount * 1e6) AS BIGINT)) AS DOUBLE) / 1e6"


def windowed(keys: str) -> str:
    """Sliding 5 minute windows every 15 seconds, by copying every row into its 20 windows."""
    return f"""
SELECT w AS window_start, w + INTERVAL 5 MINUTE AS window_end, {keys}, count(*) AS event_count FROM (
  SELECT time_bucket(INTERVAL 15 SECOND, event_time, TIMESTAMP '1970-01-01') - i * INTERVAL 15 SECOND AS w, {keys}
  FROM readings, range(20) g(i)) x GROUP BY w, {keys}"""


@query("agg1_sliding_counts", windowed("farm_id, sensor_type"))
def sliding_counts(t):
    return panes.sliding_counts(t.readings, "event_time", ["farm_id", "sensor_type"])


@query("agg2_total_beside_page", """
SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total,
  (SELECT CAST(greatest(1, ceil(count(*) / 10.0)) AS BIGINT) FROM customer) AS pages
FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 10 OFFSET 20""")
def total_beside_page(t):
    from loam.plans.paging import page
    return page(t.table("customer"), "c_acctbal", "c_custkey", 3, 10).select(
        "c_custkey", "c_name", "total", "pages")


@query("agg3_distinct_topics", "SELECT DISTINCT topic FROM messages")
def distinct_topics(t):
    return readings.distinct_topics(t.messages)


@query("agg3_distinct_types", """
SELECT DISTINCT CASE e.event_type WHEN 'view' THEN 'soil' WHEN 'click' THEN 'co2' WHEN 'purchase' THEN 'weather'
  WHEN 'signup' THEN 'temperature' ELSE 'unknown' END AS sensor_type
FROM events e JOIN messages m ON e.event_id = m.event_id WHERE m.value <> 'not json' AND m.topic NOT IN ('iot.7', 'iot.a.b.c')""")
def distinct_types(t):
    return readings.distinct_types(t.messages)


@query("agg4_status_counts", """
SELECT tenant_id, count(*) AS total, CAST(count(*) FILTER (status = 'active') AS BIGINT) AS active,
  CAST(count(*) FILTER (status = 'error') AS BIGINT) AS error FROM sensors GROUP BY tenant_id""")
def status_counts(t):
    return registry.status_counts(t.sensors, ["tenant_id"])


@query("agg5_sensor_types", "SELECT tenant_id, count(DISTINCT sensor_type) AS types FROM sensors GROUP BY tenant_id")
def sensor_types(t):
    return t.sensors.groupBy("tenant_id").agg(F.count_distinct("sensor_type").alias("types"))


@query("agg6_crop_varieties", """
SELECT tenant_id, count(DISTINCT lower(crop)) AS varieties FROM (
  SELECT tenant_id, unnest(crops) AS crop FROM farms) x GROUP BY tenant_id""")
def crop_varieties(t):
    return farms.crop_varieties(t.farms, ["tenant_id"])


_OVERLAID = """(SELECT s.*, l.message_count AS live_count, coalesce(l.message_count, s.message_count) AS messages
  FROM sensors s LEFT JOIN live l ON s.sensor_id = l.sensor_id)"""
_STORED = "CASE WHEN storage_bytes > 0 THEN storage_bytes ELSE messages * 300 END"


def overlaid(t):
    return metering.with_live_counts(t.sensors, t.live)


@query("agg7_total_messages", f"""
SELECT tenant_id, CAST(CASE WHEN count(live_count) > 0 THEN sum(live_count) ELSE sum(message_count) END AS BIGINT)
  AS dashboard_messages, CAST(sum(messages) AS BIGINT) AS overlay_messages FROM {_OVERLAID} x GROUP BY tenant_id""")
def total_messages(t):
    return metering.total_messages(overlaid(t))


@query("agg8_running_cost", f"""
WITH m AS (SELECT tenant_id, sum(messages * 0.0005e0) AS message_cost,
    sum({_STORED} / 1024e0 * (0.50e0 / 1048576)) AS storage_cost FROM {_OVERLAID} x GROUP BY tenant_id),
q AS (SELECT CAST(billing_id AS STRING) AS tenant_id, {SUM} AS query_cost FROM ledger
  WHERE reference LIKE 'QRY-%' GROUP BY 1),
g AS (SELECT m.*, coalesce(q.query_cost, 0) AS query_cost FROM m LEFT JOIN q ON m.tenant_id = q.tenant_id),
s AS (SELECT *, message_cost + storage_cost + query_cost AS grand_total FROM g)
SELECT tenant_id, round(message_cost, 6) AS message_cost, round(storage_cost, 6) AS storage_cost,
  query_cost, round(grand_total, 6) AS grand_total,
  round(message_cost / grand_total * 100, 1) AS message_pct, round(storage_cost / grand_total * 100, 1) AS storage_pct,
  round(query_cost / grand_total * 100, 1) AS query_pct FROM s""")
def running_cost(t):
    spend = metering.query_spend(t.ledger) \
        .withColumn("tenant_id", F.col("billing_id").cast("string"))
    rows = metering.running_cost(metering.with_costs(overlaid(t)), spend)
    rounded = [F.round(c, 6).alias(c) for c in ("message_cost", "storage_cost", "grand_total")]
    return rows.select("tenant_id", "query_cost", *rounded, "message_pct", "storage_pct", "query_pct")


@query("agg8_sensor_costs", f"""
SELECT sensor_id, messages, round(messages * 0.0005e0, 6) AS message_cost,
  round({_STORED} / 1024e0 * (0.50e0 / 1048576), 9) AS storage_cost,
  round(messages * 0.0005e0 + {_STORED} / 1024e0 * (0.50e0 / 1048576), 6) AS total_cost FROM {_OVERLAID} x""")
def sensor_costs(t):
    return metering.with_costs(overlaid(t)).select(
        "sensor_id", "messages", F.round("message_cost", 6).alias("message_cost"),
        F.round("storage_cost", 9).alias("storage_cost"), F.round("total_cost", 6).alias("total_cost"))


@query("agg9_unbudgeted_cost", f"""
SELECT tenant_id, round(u, 4) AS unbudgeted_cost, balance,
  CASE WHEN u > balance AND balance >= 0 THEN 'exhausted'
    WHEN u >= balance * 0.8e0 AND u <= balance AND balance > 0 THEN 'low' ELSE 'ok' END AS alert
FROM (SELECT x.tenant_id, sum(CASE WHEN budget IS NULL THEN messages * 0.0005e0 ELSE 0 END) AS u,
  any_value(b.balance) AS balance FROM {_OVERLAID} x JOIN (
    SELECT tenant_id, arg_min(balance, sensor_id) / 10 AS balance FROM sensors GROUP BY 1) b
  ON x.tenant_id = b.tenant_id GROUP BY x.tenant_id) y""")
def unbudgeted_cost(t):
    balances = t.sensors.groupBy("tenant_id").agg((F.min_by("balance", "sensor_id") / 10).alias("balance"))
    return metering.unbudgeted(overlaid(t), balances).withColumn(
        "unbudgeted_cost", F.round("unbudgeted_cost", 4))


@query("agg10_over_budget", f"""
SELECT tenant_id, CAST((rn - 1) // 1000 + 1 AS BIGINT) AS page, string_agg(sensor_name, ', ' ORDER BY sensor_name, sensor_id) AS names,
  count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY sensor_name, sensor_id) AS rn FROM {_OVERLAID} x
  WHERE budget > 0 AND messages * 0.0005e0 >= budget) y GROUP BY 1, 2""")
def over_budget(t):
    return metering.over_budget_names(overlaid(t)).select(
        "tenant_id", "page", F.array_join("items", ", ").alias("names"), F.size("items").cast("long").alias("n"))


@query("agg11_stored_volume", f"""
SELECT tenant_id, CAST(sum({_STORED}) AS BIGINT) AS total_bytes, round(sum({_STORED}) / 1048576e0, 6) AS total_mb,
  round(sum({_STORED}) / 1073741824e0, 9) AS total_gb FROM {_OVERLAID} x GROUP BY tenant_id""")
def stored_volume(t):
    return metering.stored_volume(overlaid(t)).withColumn("total_mb", F.round("total_mb", 6)) \
        .withColumn("total_gb", F.round("total_gb", 9))


_SPEND = f"""count(*) AS query_count, CAST(sum(data_points) AS DOUBLE) AS total_qu, {SUM} AS total_cost"""


@query("agg12_query_spend", f"""
SELECT billing_id, 'all' AS scope, {_SPEND} FROM ledger WHERE reference LIKE 'QRY-%' GROUP BY 1
UNION ALL SELECT billing_id, 'sensor', {_SPEND} FROM ledger
WHERE reference LIKE 'QRY-%' AND contains(lower(description), 's-14') GROUP BY 1
UNION ALL SELECT billing_id, 'farm', {_SPEND} FROM ledger
WHERE reference LIKE 'QRY-%' AND contains(lower(description), 'f-3') GROUP BY 1""")
def query_spend(t):
    scopes = {"all": {}, "sensor": {"sensor_id": "S-14", "farm_id": "f-3"}, "farm": {"farm_id": "f-3"}}
    parts = [metering.query_spend(t.ledger, **ids).select(
        "billing_id", F.lit(name).alias("scope"), "query_count", "total_qu", "total_cost") for name, ids in scopes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("agg13_cycle_summary", f"""
WITH g AS (SELECT billing_id, usage_period,
  arg_max(amount, (created_at, id)) FILTER (reference LIKE 'CYCLE-%') AS amount,
  arg_max(data_points, (created_at, id)) FILTER (reference LIKE 'CYCLE-%') AS messages,
  arg_max(created_at, (created_at, id)) FILTER (reference LIKE 'CYCLE-%') AS cycle_date,
  CAST(count(*) FILTER (type = 'usage') AS BIGINT) AS query_items,
  coalesce(CAST(sum(CAST(round(amount * 1e6) AS BIGINT)) FILTER (type = 'usage') AS DOUBLE) / 1e6, 0) AS qc, coalesce(sum(data_points) FILTER (type = 'usage'), 0) AS qu
  FROM ledger GROUP BY 1, 2)
SELECT billing_id, usage_period, coalesce(amount, 0) AS cycle_amount, cycle_date, coalesce(messages, 0) AS message_count,
  round(coalesce(messages, 0) * 0.0005e0, 6) AS message_cost, query_items, qc AS query_total_cost,
  CAST(qu AS DOUBLE) AS query_total_qu,
  round(greatest(0e0, coalesce(amount, 0) - coalesce(messages, 0) * 0.0005e0 - qc), 6) AS storage_cost FROM g""")
def cycle_summary(t):
    return metering.cycle_summary(t.ledger).withColumn("storage_cost", F.round("storage_cost", 6))


@query("agg13_cycle_items", """
SELECT billing_id, usage_period, id, created_at, amount, data_points, description FROM ledger WHERE type = 'usage'""")
def cycle_items(t):
    return metering.cycle_items(t.ledger)


@query("agg14_device_snapshot", """
SELECT tenant_id, CAST((rn - 1) // 1000 + 1 AS BIGINT) AS page,
  string_agg(concat(sensor_id, ':', sensor_name, ':', status), ';' ORDER BY sensor_id) AS devices
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY sensor_id) AS rn FROM sensors) x GROUP BY 1, 2""")
def device_snapshot(t):
    text = F.transform("items", lambda d: F.concat_ws(":", d["sensor_id"], d["name"], d["status"]))
    return registry.device_snapshot(t.sensors).select(
        "tenant_id", "page", F.array_join(text, ";").alias("devices"))


@query("agg15_amount_due", """
SELECT b.billing_id, round(b.message_count * 1e-6 + b.sensor_count * 1.0e0 + coalesce(x.cost, 0), 6) AS amount_due
FROM billings b LEFT JOIN (SELECT billing_id, sum(data_points * 0.5e0) AS cost FROM ledger WHERE type = 'credit'
  GROUP BY 1) x ON b.billing_id = x.billing_id""")
def amount_due(t):
    rows = billing.subscription_costs(t.billings, subscriptions(t))
    return billing.with_amount_due(rows).select("billing_id", F.round("amount_due", 6).alias("amount_due"))


@query("agg16_message_counters", """
SELECT tenant_id, sensor_id, CAST(sum(increment) AS BIGINT) AS message_count, max(event_time) AS last_message_at,
  min(event_time) AS activated_at FROM readings GROUP BY 1, 2""")
def message_counters(t):
    return readings.message_counters(t.readings)


@query("agg17_topic_counts", """
SELECT topic, CAST(sum(hi) AS BIGINT) AS message_count, CAST(sum(hi - lo) AS BIGINT) AS retained_count FROM (
  SELECT topic, partition, max("offset") + 1 AS hi, min("offset") AS lo FROM messages GROUP BY 1, 2) x GROUP BY topic""")
def topic_counts(t):
    return readings.topic_message_counts(t.messages)


@query("agg18_latest_hardware", """
SELECT topic, arg_max(concat('v', CAST(event_id % 9 AS STRING)), k) AS firmware_version,
  CAST(arg_max(event_id % 100, k) AS DOUBLE) AS battery_level_percent, arg_max(event_id % 64, k) AS memory_free_mb,
  CAST(128 AS BIGINT) AS memory_total_mb
FROM (SELECT *, (timestamp, partition, "offset") AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY topic, partition ORDER BY "offset" DESC) AS back FROM messages) y
  WHERE back <= 10 AND value <> 'not json' AND event_id % 3 > 0) x
GROUP BY topic""")
def latest_hardware(t):
    return readings.latest_hardware(t.messages).drop("mac_address", "ip_address")


@query("agg19_lag", """
SELECT ts, topic, kafka_partition, CAST(sum(consumer_lag) AS BIGINT) AS consumer_lag FROM samples GROUP BY 1, 2, 3""")
def lag(t):
    return monitoring.lag_by_partition(t.samples)


def _counter(column="messages_in_total"):
    """The counter as it looks when its process restarts once a day."""
    return f"""(SELECT *, {column} - first_value({column}) OVER (PARTITION BY topic, kafka_partition, CAST(ts AS DATE)
      ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS counter FROM samples)"""


@query("agg20_counter_rate", f"""
SELECT topic, time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 1 SECOND, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end,
  round(sum(CASE WHEN before IS NULL THEN 0 WHEN counter < before THEN counter ELSE counter - before END) / 21600e0, 9) AS rate
FROM (SELECT *, lag(counter) OVER (PARTITION BY topic, kafka_partition ORDER BY ts) AS before FROM {_counter()} c) x
GROUP BY 1, 2""")
def counter_rate(t):
    return monitoring.counter_rate(_restarted(t), ["topic", "kafka_partition"], "counter", ["topic"], 6 * 3600) \
        .withColumn("rate", F.round("rate", 9))


@query("agg20_rates_at_steps", f"""
WITH d AS (SELECT topic, kafka_partition, ts, counter, lag(counter) OVER (PARTITION BY topic, kafka_partition ORDER BY ts) AS before
    FROM {_counter()} c),
  x AS (SELECT *, sum(CASE WHEN before IS NULL THEN 0 WHEN counter < before THEN counter ELSE counter - before END)
    OVER (PARTITION BY topic, kafka_partition ORDER BY ts) AS total FROM d),
  steps AS (SELECT unnest(generate_series(min(ts), max(ts) + INTERVAL 6 HOUR, INTERVAL 1 HOUR)) AS step FROM samples),
  r AS (SELECT x.topic, x.kafka_partition, g.range_s, steps.step, max(total) - min(total) AS rise
    FROM steps CROSS JOIN (VALUES (CAST(7200 AS BIGINT)), (CAST(21600 AS BIGINT))) g(range_s)
    JOIN x ON x.ts > steps.step - to_seconds(g.range_s) AND x.ts <= steps.step
    GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)
SELECT topic, range_s, step, round(CAST(sum(rise) AS DOUBLE) / range_s, 9) AS rate FROM r GROUP BY topic, range_s, step""")
def rates_at_steps(t):
    """A short and a long range at every hour, the step of the samples."""
    return monitoring.rates_at_steps(_restarted(t), ["topic", "kafka_partition"], "counter", ["topic"], [2 * 3600, 6 * 3600], 3600) \
        .withColumn("rate", F.round("rate", 9))


def _restarted(t):
    day = t.samples.withColumn("day", F.to_date("ts"))
    start = day.groupBy("topic", "kafka_partition", "day").agg(F.min("messages_in_total").alias("start"))
    return day.join(start, ["topic", "kafka_partition", "day"]).withColumn("counter", F.col("messages_in_total") - F.col("start"))


@query("agg21_gauges", """
SELECT ts, topic, CAST(sum(consumer_lag) AS BIGINT) AS sum_value, round(avg(consumer_lag), 6) AS avg_value,
  count(DISTINCT kafka_partition) AS partitions FROM samples GROUP BY ts, topic""")
def gauges(t):
    return monitoring.gauges(t.samples, "consumer_lag").withColumn("avg_value", F.round("avg_value", 6))


@query("agg21_highest_lag", """
SELECT topic, kafka_partition, max(consumer_lag) AS max_value FROM samples GROUP BY 1, 2""")
def highest_lag(t):
    return monitoring.highest_by_partition(t.samples, "consumer_lag")


@query("agg22_rolling_day", """
SELECT event_id, sensor_id, min(value) OVER w AS min_value, max(value) OVER w AS max_value,
  round(avg(value) OVER w, 8) AS avg_value FROM (SELECT *, CAST(floor(epoch(event_time)) AS BIGINT) AS s FROM readings) x
WINDOW w AS (PARTITION BY sensor_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""")
def rolling_day(t):
    return panes.with_trailing_stats(t.readings, "event_time", ["sensor_id"], "value").select(
        "event_id", "sensor_id", "min_value", "max_value", F.round("avg_value", 8).alias("avg_value"))


@query("agg23_query_averages", f"""
SELECT billing_id, {SUM} / count(*) AS avg_cost, CAST(sum(data_points) AS DOUBLE) / count(*) AS avg_qu FROM ledger
WHERE reference LIKE 'QRY-%' GROUP BY billing_id""")
def query_averages(t):
    rows = metering.with_averages(metering.query_spend(t.ledger))
    return rows.select("billing_id", "avg_cost", "avg_qu")


@query("agg24_recount", """
SELECT b.billing_id, coalesce(n, 0) AS sensor_count, round(b.message_count * 1e-6 + coalesce(n, 0) * 1.0e0, 6) AS amount_due
FROM billings b LEFT JOIN (SELECT tenant_id, count(*) AS n FROM sensors GROUP BY 1) s ON b.tenant_id = s.tenant_id""")
def recount(t):
    rows = billing.recount_sensors(t.billings, t.sensors).withColumn("subscription_cost", F.lit(0.0))
    return billing.with_amount_due(rows).select(
        "billing_id", "sensor_count", F.round("amount_due", 6).alias("amount_due"))


@query("flagship_hourly_readings", """
SELECT r.sensor_type, r.tenant_id, date_trunc('hour', r.event_time) AS hour, count(*) AS readings,
  count(DISTINCT r.sensor_id) AS sensors FROM (
  SELECT CASE e.event_type WHEN 'view' THEN 'soil' WHEN 'click' THEN 'co2' WHEN 'purchase' THEN 'weather'
      WHEN 'signup' THEN 'temperature' ELSE 'unknown' END AS sensor_type, x.tenant_id, x.sensor_id, x.event_time
  FROM readings x JOIN events e ON x.event_id = e.event_id JOIN messages m ON x.event_id = m.event_id
  WHERE m.value <> 'not json' AND m.topic NOT IN ('iot.7', 'iot.a.b.c')) r GROUP BY 1, 2, 3""")
def hourly_readings(t):
    rows = readings.accepted(readings.parsed(t.messages))
    return rows.groupBy("sensor_type", "tenant_id", F.date_trunc("hour", F.col("event_time")).alias("hour")).agg(
        F.count(F.lit(1)).alias("readings"), F.count_distinct("sensor_id").alias("sensors"))
