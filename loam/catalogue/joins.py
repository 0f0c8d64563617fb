"""Joins."""

from pyspark.sql import functions as F

from loam import bindings
from loam.catalogue import query
from loam.catalogue.scalars import _QU
from loam.operators import billing, farms, metering, registry
from loam.streaming import counters


@query("jn1_first_role", """
SELECT tenant_id, user_id, lower(arg_min(role_name, role_id)) AS role_name FROM (
  SELECT CAST(n.n_regionkey AS STRING) AS tenant_id, c.c_custkey AS user_id, n.n_nationkey AS role_id,
    n.n_name AS role_name FROM customer c JOIN nation n ON n.n_nationkey IN (c.c_nationkey, (c.c_nationkey + 5) % 25)) x
GROUP BY 1, 2""")
def first_role(t):
    roles = t.table("nation").select(F.col("n_regionkey").cast("string").alias("tenant_id"),
                                     F.col("n_nationkey").alias("role_id"), F.col("n_name").alias("role_name"))
    held = F.explode(F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 5) % 25))
    users = t.table("customer").select(F.col("c_custkey").alias("user_id"), held.alias("role_id"))
    tenants = roles.select("role_id", "tenant_id")
    return registry.first_role(roles, users.join(tenants, "role_id"))


@query("jn2_audit_names", """
SELECT c.change_id, c.sensor_id, c.performed_by, CASE WHEN u.user_id IS NOT NULL THEN
  coalesce(u.first_name, split_part(u.email, '@', 1)) END AS performed_by_name
FROM changes c LEFT JOIN users u ON c.performed_by = u.user_id""")
def audit_names(t):
    return registry.audit_with_names(t.changes, t.users).select(
        "change_id", "sensor_id", "performed_by", "performed_by_name")


_FIRST = """(SELECT sensor_id, min(storage_id) AS storage_id, arg_min(allocated_gb, storage_id) AS allocated_gb
  FROM allocations GROUP BY sensor_id)"""


@query("jn3_sensor_storage", f"""
SELECT s.sensor_id, a.storage_id, a.allocated_gb FROM sensors s LEFT JOIN {_FIRST} a ON s.sensor_id = a.sensor_id""")
def sensor_storage(t):
    return t.sensors.select("sensor_id").join(registry.first_allocation(t.allocations), "sensor_id", "left")


@query("jn4_unallocated", """
SELECT sensor_id, tenant_id FROM sensors WHERE sensor_id NOT IN (SELECT sensor_id FROM allocations)""")
def unallocated(t):
    return t.sensors.join(t.allocations, "sensor_id", "left_anti").select("sensor_id", "tenant_id")


@query("jn5_crop_farms", """
SELECT c.crop_id, c.farm_id, c.crop_name, f.farm_name FROM crops c LEFT JOIN farms f ON c.farm_id = f.farm_id""")
def crop_farms(t):
    return farms.crops_with_farm(t.crops, t.farms).select("crop_id", "farm_id", "crop_name", "farm_name")


@query("jn6_farm_sensors", """
SELECT s.sensor_id, f.farm_id, f.farm_name FROM sensors s JOIN farms f
  ON s.farm_id = f.farm_id OR s.metadata_farm_id = f.farm_id""")
def farm_sensors(t):
    return registry.sensors_of_farms(t.sensors, t.farms).select("sensor_id", "farm_id", "farm_name")


@query("jn7_live_overlay", """
SELECT s.sensor_id, s.message_count, l.message_count AS live_count,
  coalesce(l.message_count, s.message_count) AS messages FROM sensors s LEFT JOIN live l ON s.sensor_id = l.sensor_id""")
def live_overlay(t):
    return metering.with_live_counts(t.sensors, t.live).select(
        "sensor_id", "message_count", "live_count", "messages")


@query("jn8_new_crops", """
SELECT DISTINCT x.farm_id, x.crop_name FROM (SELECT farm_id, unnest(crops) AS crop_name FROM farms) x
WHERE NOT EXISTS (SELECT 1 FROM crops c WHERE c.farm_id = x.farm_id AND c.crop_name = x.crop_name)""")
def new_crops(t):
    return farms.new_crop_records(t.farms, t.crops)


@query("jn8_new_farms", """
SELECT tenant_id, farm_name, min(key) AS key FROM (
  SELECT CAST(c_nationkey AS STRING) AS tenant_id, concat('Supplier#', lpad(CAST(c_custkey // 2 AS STRING), 9, '0')) AS farm_name,
    c_custkey // 2 AS key FROM customer) x
WHERE NOT EXISTS (SELECT 1 FROM farms f WHERE f.tenant_id = x.tenant_id AND f.farm_name = x.farm_name)
GROUP BY 1, 2""")
def new_farms(t):
    half = F.floor(F.col("c_custkey") / 2)
    incoming = t.table("customer").select(
        F.col("c_nationkey").cast("string").alias("tenant_id"),
        F.concat(F.lit("Supplier#"), F.lpad(half.cast("string"), 9, "0")).alias("farm_name"), half.alias("key"))
    return registry.insert_missing(t.farms, incoming, ["tenant_id", "farm_name"])


@query("jn9_query_spend_by_sensor", """
WITH c AS (SELECT b.tenant_id, CAST(round(l.amount * 1e6) AS BIGINT) AS amount, data_points, lower(description) AS d
  FROM ledger l JOIN billings b ON l.billing_id = b.billing_id WHERE reference LIKE 'QRY-%'),
own AS (SELECT s.tenant_id, s.sensor_id, count(*) AS n, sum(data_points) AS qu, sum(amount) AS cost
  FROM sensors s JOIN c ON s.tenant_id = c.tenant_id AND contains(c.d, lower(s.sensor_id)) GROUP BY 1, 2),
farm AS (SELECT f.tenant_id, f.farm_id, count(*) AS n, sum(data_points) AS qu, sum(amount) AS cost
  FROM (SELECT DISTINCT tenant_id, farm_id FROM sensors) f JOIN c ON f.tenant_id = c.tenant_id AND contains(c.d, lower(f.farm_id)) GROUP BY 1, 2)
SELECT s.tenant_id, s.sensor_id, s.farm_id, coalesce(o.n, f.n, 0) AS query_count,
  CAST(coalesce(o.qu, f.qu, 0) AS DOUBLE) AS total_qu, CAST(coalesce(o.cost, f.cost, 0) AS DOUBLE) / 1e6 AS total_cost
FROM sensors s LEFT JOIN own o ON s.tenant_id = o.tenant_id AND s.sensor_id = o.sensor_id
LEFT JOIN farm f ON s.tenant_id = f.tenant_id AND s.farm_id = f.farm_id""")
def query_spend_by_sensor(t):
    return metering.query_spend_by_sensor(t.ledger, t.sensors, t.billings)


@query("jn10_routed_messages", """
SELECT replace(m.topic, '.', '/') AS key, r.target AS topic, m.value FROM messages m
JOIN routes r ON replace(m.topic, '.', '/') = r.path""")
def routed_messages(t):
    messages = t.messages.withColumn("path", F.replace("topic", F.lit("."), F.lit("/"))).drop("topic")
    return counters.route(messages, t.routes)


SESSIONS = """(SELECT o_orderkey AS session_id, o_custkey AS user_id, CAST(o_custkey % 25 AS STRING) AS tenant_id,
  o_orderdate + INTERVAL 400 DAY AS expires_at, CASE WHEN o_orderstatus = 'F' THEN 'revoked' ELSE 'active' END AS status
  FROM orders)"""


@query("jn11_active_sessions", f"""
SELECT s.session_id, s.user_id, s.tenant_id, u.email FROM {SESSIONS} s
JOIN users u ON s.user_id = u.user_id AND s.tenant_id = u.tenant_id
WHERE s.status = 'active' AND s.expires_at > TIMESTAMP '{bindings.LEDGER_NOW}'""")
def active_sessions(t):
    sessions = t.table("orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"),
        (F.col("o_custkey") % 25).cast("string").alias("tenant_id"),
        (F.col("o_orderdate") + F.expr("INTERVAL 400 DAY")).cast("timestamp").alias("expires_at"),
        F.when(F.col("o_orderstatus") == "F", "revoked").otherwise("active").alias("status"))
    return registry.active_sessions(sessions, t.users, bindings.LEDGER_NOW).select(
        "session_id", "user_id", "tenant_id", "email")


def subscriptions(t):
    return t.ledger.filter("type = 'credit'").select(
        F.col("billing_id"), F.col("id"), (F.col("data_points") * 0.5).alias("cost"))


@query("jn12_subscription_costs", """
SELECT b.billing_id, coalesce(x.cost, 0e0) AS subscription_cost FROM billings b LEFT JOIN (
  SELECT billing_id, sum(data_points * 0.5e0) AS cost FROM ledger WHERE type = 'credit' GROUP BY 1) x
ON b.billing_id = x.billing_id""")
def subscription_costs(t):
    return billing.subscription_costs(t.billings, subscriptions(t)).select("billing_id", "subscription_cost")


@query("jn13_query_gate", """
SELECT q.query_id, q.tenant_id, coalesce(b.balance >= 5000, FALSE) AS allowed FROM query_stats q LEFT JOIN (
  SELECT tenant_id, arg_min(balance, billing_id) AS balance FROM billings GROUP BY 1) b ON q.tenant_id = b.tenant_id""")
def query_gate(t):
    return metering.gate_queries(t.query_stats, first_billings(t)).select("query_id", "tenant_id", "allowed")


def first_billings(t):
    """The first billing of each tenant, active from a balance of 5,000 on."""
    first = t.billings.groupBy("tenant_id").agg(F.min_by("balance", "billing_id").alias("balance"))
    return first.withColumn("status", F.when(F.col("balance") >= 5000, "active").otherwise("suspended"))


@query("jn13_metered_runs", f"""
SELECT query_id, q.tenant_id, user_id, run_at, qu, sql, 'usage' AS type, round(qu * 0.01e0, 6) AS amount,
  concat('Query — ', printf('%.2f', qu), ' QU · ', substr(sql, 1, 120)) AS description,
  CAST(round_even(qu, 0) AS INT) AS data_points, strftime(run_at, '%Y-%m') AS usage_period
FROM (SELECT *, {_QU} AS qu FROM query_stats) q JOIN (
  SELECT tenant_id, arg_min(balance, billing_id) AS balance FROM billings GROUP BY 1) b
ON q.tenant_id = b.tenant_id WHERE b.balance >= 5000""")
def metered_runs(t):
    return metering.metered_runs(t.query_stats, first_billings(t))
