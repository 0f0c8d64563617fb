"""Ordered analytics: running values, latest rows, freezes, alerts."""

from pyspark.sql import functions as F

from loam import bindings
from loam.catalogue import query
from loam.catalogue.projections import flagged_sensors
from loam.operators import billing, console, metering, monitoring, readings, registry

ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("win1_share_of_total", """
SELECT sensor_id, tenant_id, round(CASE WHEN sum(message_count) OVER w > 0
  THEN message_count / CAST(sum(message_count) OVER w AS DOUBLE) * 100 ELSE 0 END, 6) AS share_pct
FROM sensors WINDOW w AS (PARTITION BY tenant_id)""")
def share_of_total(t):
    rows = metering.share_of_total(t.sensors, "message_count")
    return rows.select("sensor_id", "tenant_id", F.round("share_pct", 6).alias("share_pct")) \
        .orderBy(F.desc("share_pct"), "sensor_id")


@query("win2_balance_after", f"""
SELECT id, billing_id, amount, CAST(sum(CAST(round(amount * 1e6) AS BIGINT)) OVER (
  PARTITION BY billing_id ORDER BY created_at, id {ROWS}) AS DOUBLE) / 1e6 AS balance_after FROM ledger WHERE type = 'credit'""")
def balance_after(t):
    return billing.balance_after(t.ledger.filter("type = 'credit'")).select(
        "id", "billing_id", "amount", "balance_after")


@query("win3_clamped_count", f"""
SELECT tenant_id, id, CAST(s - least(0, min(s) OVER (PARTITION BY tenant_id ORDER BY happened_at, id {ROWS})) AS BIGINT) AS sensor_count
FROM (SELECT *, sum(sensors) OVER (PARTITION BY tenant_id ORDER BY happened_at, id {ROWS}) AS s FROM epoch_events
  WHERE kind = 'sensors') x""")
def clamped_count(t):
    changes = t.epoch_events.filter("kind = 'sensors'")
    return billing.clamped_counts(changes, ["tenant_id"], ["happened_at", "id"], "sensors").select(
        "tenant_id", "id", F.col("sensor_count").cast("long").alias("sensor_count"))


def _series(kept: str) -> str:
    return f"""
WITH a AS (SELECT *, sum(messages) OVER w AS cm, sum(sensors) OVER w AS rs, sum(CAST(round(cost * 1e6) AS BIGINT)) OVER w AS cc
  FROM epoch_events WINDOW w AS (PARTITION BY tenant_id ORDER BY happened_at, id {ROWS})),
b AS (SELECT *, rs - least(0, min(rs) OVER w) AS cs,
    last_value(CASE WHEN kind <> 'query' THEN cc END IGNORE NULLS) OVER w AS counted
  FROM a WINDOW w AS (PARTITION BY tenant_id ORDER BY happened_at, id {ROWS})),
d AS (SELECT b.*, l.balance, CASE WHEN counted IS NULL THEN 0 ELSE cm * 1e-6 + cs * 1.0e0 + s.subscription_cost END
    + (cc - {kept}) / 1e6 AS due FROM b JOIN balances l ON b.tenant_id = l.tenant_id
  JOIN subscriptions s ON b.tenant_id = s.tenant_id)
SELECT tenant_id, CASE WHEN count(*) FILTER (due > balance) > 0 THEN 'suspended' ELSE 'active' END AS status,
  arg_min(id, (happened_at, id)) FILTER (due > balance) AS suspended_by,
  round(coalesce(arg_min(due, (happened_at, id)) FILTER (due > balance), arg_max(due, (happened_at, id))), 6) AS amount_due,
  CAST(arg_max(cm, (happened_at, id)) AS BIGINT) AS message_count, CAST(arg_max(cs, (happened_at, id)) AS BIGINT) AS sensor_count
FROM d GROUP BY tenant_id"""


def freeze(t, mode):
    rows = billing.overdraft_freeze(t.epoch_events, t.balances, t.subscriptions, mode)
    return rows.withColumn("amount_due", F.round("amount_due", 6)) \
        .withColumn("sensor_count", F.col("sensor_count").cast("long"))


@query("win4_overdraft_freeze", _series("coalesce(counted, 0)"))
def overdraft_freeze(t):
    return freeze(t, "reference")


@query("win4_overdraft_freeze_additive", _series("0"))
def overdraft_freeze_additive(t):
    return freeze(t, "additive")


@query("win5_latest_reading", """
SELECT sensor_id, arg_max(event_id, (event_time, event_id)) AS event_id, max(event_time) AS event_time,
  arg_max(value, (event_time, event_id)) AS value FROM readings GROUP BY sensor_id""")
def latest_reading(t):
    return readings.latest_per_sensor(t.readings, ["sensor_id"], ["event_time", "event_id"],
                                      ["event_id", "event_time", "value"])


_HISTORY_NOW = "2001-11-01 00:00:00"


@query("win6_query_history", f"""
SELECT tenant_id, user_id, query_id, run_at FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY run_at DESC, query_id DESC) AS rn
  FROM query_stats WHERE run_at >= TIMESTAMP '2000-06-01' - INTERVAL 2400 HOUR) x WHERE rn <= 20""")
def query_history(t):
    return console.query_history(t.query_stats, "2000-06-01", keep=20, hours=2400).select(
        "tenant_id", "user_id", "query_id", "run_at")


@query("win6_last_statement", """
SELECT tenant_id, user_id, arg_max(sql, (run_at, query_id, sql)) AS last_sql FROM query_stats GROUP BY 1, 2""")
def last_statement(t):
    return console.last_statement(t.query_stats)


@query("win7_last_messages", """
SELECT sensor_id, event_id, event_time FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id
  ORDER BY event_time DESC, event_id DESC) AS rn FROM readings) x WHERE rn <= 5""")
def last_messages(t):
    return readings.last_messages(t.readings, 5).select("sensor_id", "event_id", "event_time")


@query("win8_sustained_lag", f"""
WITH r AS (SELECT *, sum(CASE WHEN consumer_lag > 1000 THEN 0 ELSE 1 END) OVER (
    PARTITION BY topic, kafka_partition ORDER BY ts {ROWS}) AS run FROM samples)
SELECT topic, kafka_partition, min(ts) AS started_at, max(ts) AS last_breach_at, count(*) AS samples,
  max(consumer_lag) AS peak FROM r WHERE consumer_lag > 1000 GROUP BY topic, kafka_partition, run
HAVING max(ts) - min(ts) >= INTERVAL 2 HOUR""")
def sustained_lag(t):
    return monitoring.sustained_alerts(t.samples, ["topic", "kafka_partition"], "consumer_lag", 1000, 2 * 3600)


@query("win9_activation", """
SELECT s.sensor_id, s.tenant_id, 'active' AS status, 'data_received' AS event_type,
  'First data message received. Sensor is now active.' AS message, f.messages, f.created_at
FROM sensors s JOIN (SELECT sensor_id, arg_min(increment, (event_time, event_id)) AS messages,
  min(event_time) AS created_at FROM readings GROUP BY 1) f ON s.sensor_id = f.sensor_id
WHERE s.status = 'inactive'""")
def activation(t):
    pending = t.sensors.withColumn("status", F.when(F.col("status") == "inactive", "pending")
                                   .otherwise(F.col("status")))
    return readings.activations(t.readings, pending)


_DUE = """CASE frequency WHEN 'daily' THEN n + INTERVAL 1 DAY WHEN 'weekly' THEN n + INTERVAL 7 DAY
  WHEN 'monthly' THEN n + INTERVAL 1 MONTH WHEN 'quarterly' THEN n + INTERVAL 3 MONTH
  WHEN 'yearly' THEN n + INTERVAL 1 YEAR ELSE n END"""


@query("win10_settled_billings", f"""
SELECT billing_id, round(balance - least(amount_due, balance), 4) AS balance,
  CASE WHEN balance - least(amount_due, balance) <= 0 THEN 'suspended' ELSE 'active' END AS status, {_DUE} AS due_date
FROM (SELECT *, TIMESTAMP '{bindings.NOW}' AS n FROM billings) x""")
def settled_billings(t):
    rows, _ = billing.settle_cycles(t.billings, bindings.NOW)
    return rows.select("billing_id", F.round("balance", 4).alias("balance"), "status", "due_date")


@query("win10_cycle_debits", f"""
SELECT billing_id, 'debit' AS type, round(least(amount_due, balance), 4) AS amount,
  round(balance - least(amount_due, balance), 4) AS balance_after,
  concat('Billing cycle charge — ', format('{{:,}}', message_count), ' messages') AS description, '2024-01' AS usage_period,
  message_count AS data_points,
  concat('CYCLE-', upper(substr(md5(concat(CAST(billing_id AS STRING), '|{bindings.NOW}')), 1, 8))) AS reference
FROM billings""")
def cycle_debits(t):
    _, debits = billing.settle_cycles(t.billings, bindings.NOW)
    return debits.drop("created_at").withColumn("amount", F.round("amount", 4)) \
        .withColumn("balance_after", F.round("balance_after", 4))


def suspended_tenants(t):
    """Tenants whose first billing is below zero or low."""
    first = t.billings.groupBy("tenant_id").agg(F.min_by("balance", "billing_id").alias("b"))
    return first.filter("b < 5000").select("tenant_id")


_TENANTS = """(SELECT tenant_id FROM (SELECT tenant_id, arg_min(balance, billing_id) AS b FROM billings GROUP BY 1) z
  WHERE b < 5000)"""


@query("win11_suspension", f"""
SELECT sensor_id, tenant_id, 'status_changed' AS action, 'inactive' AS status, 'sensor_suspended' AS event_type,
  'system' AS performed_by, 'active>inactive: billing_suspended' AS details,
  concat(CASE WHEN TRUE THEN 'billing_suspended=true;' END, 'model=m-', farm_id) AS metadata
FROM sensors WHERE status = 'active' AND tenant_id IN (SELECT tenant_id FROM {_TENANTS} y)""")
def suspension(t):
    from loam.catalogue.scalars import _map_text
    rows, audit, events = registry.suspend(flagged_sensors(t), suspended_tenants(t))
    return (rows.select("sensor_id", "status", _map_text(F.col("metadata")).alias("metadata"))
            .join(audit.select("sensor_id", "action", "performed_by"), "sensor_id")
            .join(events.select("sensor_id", "tenant_id", "event_type", F.concat(
                F.col("details.old_status"), F.lit(">"), F.col("details.new_status"), F.lit(": "), F.col("details.reason")).alias("details")), "sensor_id"))


@query("win12_reactivation", f"""
SELECT sensor_id, 'active' AS status, concat('model=m-', farm_id) AS metadata, 'sensor_reconnected' AS event_type
FROM sensors WHERE status = 'inactive' AND contains(sensor_id, '7')
  AND tenant_id IN (SELECT tenant_id FROM {_TENANTS} y)""")
def reactivation(t):
    from loam.catalogue.scalars import _map_text
    rows, events = registry.reactivate(flagged_sensors(t), suspended_tenants(t))
    return rows.select("sensor_id", "status", _map_text(F.col("metadata")).alias("metadata")) \
        .join(events.select("sensor_id", "event_type"), "sensor_id")


@query("win13_current_registry", """
SELECT sensor_id, tenant_id, sensor_name, status, changed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY changed_at DESC, change_id DESC) AS rn FROM changes) x
WHERE rn = 1 AND op <> 'delete'""")
def current_registry(t):
    return registry.current_registry(t.changes)


@query("win13_audit_trail", f"""
WITH p AS (SELECT *, lag(op) OVER w AS pop, lag(sensor_name) OVER w AS old_name, lag(status) OVER w AS old_status,
  last_value(sensor_name IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY changed_at, change_id {ROWS}) AS known
  FROM changes WINDOW w AS (PARTITION BY sensor_id ORDER BY changed_at, change_id))
SELECT change_id, sensor_id, tenant_id, known AS sensor_name, CASE WHEN op = 'delete' THEN 'deleted'
  WHEN pop IS NULL OR pop = 'delete' THEN 'created' WHEN status <> old_status THEN 'status_changed'
  WHEN sensor_name <> old_name THEN 'renamed' ELSE 'updated' END AS action, old_name, old_status, performed_by,
  changed_at AS created_at FROM p""")
def audit_trail(t):
    return registry.audit_trail(t.changes)


@query("win14_payment_reset", f"""
SELECT b.billing_id, CASE WHEN p THEN 0 ELSE message_count END AS message_count,
  CASE WHEN p THEN 0 ELSE sensor_count END AS sensor_count, CASE WHEN p THEN 0 ELSE amount_due END AS amount_due,
  CASE WHEN p THEN n END AS last_payment_date, CASE WHEN p THEN {_DUE} ELSE due_date END AS due_date,
  CASE WHEN p THEN 'active' ELSE status END AS status
FROM (SELECT b.*, TIMESTAMP '{bindings.NOW}' AS n, l.billing_id IS NOT NULL AS p FROM billings b LEFT JOIN (
  SELECT DISTINCT billing_id FROM ledger WHERE type = 'credit') l ON b.billing_id = l.billing_id) b""")
def payment_reset(t):
    return billing.reset_on_payment(t.billings, t.ledger.filter("type = 'credit'"), bindings.NOW)
