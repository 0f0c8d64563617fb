"""Pages, top-k, sorts and set-based replacement."""

from pyspark.sql import functions as F

from loam import bindings
from loam.catalogue import query
from loam.catalogue.aggregates import _OVERLAID, _STORED, overlaid
from loam.catalogue.projections import TOKENS, tenant_console, tokens
from loam.operators import metering, readings, registry
from loam.plans.paging import page
from loam.plans.ranks import RankIndex
from loam.session import scratch


@query("ord1_ledger_page", """
SELECT id, created_at, type, (SELECT count(*) FROM ledger WHERE billing_id = 7) AS total,
  (SELECT CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) FROM ledger WHERE billing_id = 7) AS pages
FROM ledger WHERE billing_id = 7 ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20""")
def ledger_page(t):
    rows = t.ledger.filter("billing_id = 7")
    return page(rows, "created_at", "id", 2, 20).select("id", "created_at", "type", "total", "pages")


@query("ord1_far_pages", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY billing_id ORDER BY created_at DESC, id DESC) AS rn,
  count(*) OVER (PARTITION BY billing_id) AS total FROM ledger)
SELECT billing_id, id, created_at, total, CAST(greatest(1, ceil(total / 20.0)) AS BIGINT) AS pages FROM n
WHERE billing_id IN (7, 11) AND rn > (ceil(total / 20.0) - 1) * 20""")
def far_pages(t):
    """The last pages of two billings, read from one index of the whole ledger."""
    index = RankIndex.build(t.ledger, ["billing_id"], [F.desc("created_at"), F.desc("id")])

    def last(billing):
        total = index.ranges.where(F.col("billing_id") == billing).agg(F.sum("n")).first()[0] or 0
        return index.page(max(1, -(-total // 20)), 20, billing_id=billing)
    return last(7).unionByName(last(11)).select("billing_id", "id", "created_at", "total", "pages")


@query("ord2_latest_of_sensor", """
SELECT event_id, event_time, metrics FROM readings WHERE sensor_id = 's-10' AND tenant_id = '3'
ORDER BY event_time DESC, event_id DESC LIMIT 100""")
def latest_of_sensor(t):
    return readings.latest_of_sensor(t.readings, "s-10", "3").select("event_id", "event_time", "metrics")


@query("ord2_newest_days", """
SELECT event_id, event_time, metrics FROM readings WHERE sensor_id = 's-10' AND tenant_id = '3'
ORDER BY event_time DESC, event_id DESC LIMIT 5""")
def newest_days(t):
    """The same from a table laid out by day, of which only the newest days are read."""
    root = scratch(t.spark, "ord2")
    database = "loam_" + root.rsplit("-", 1)[1]
    t.spark.sql(f"CREATE DATABASE {database} LOCATION '{root}'")
    dated = t.readings.withColumn("event_date", F.to_date("event_time")).repartition("event_date")
    dated.sortWithinPartitions("tenant_id", "sensor_id").write.partitionBy("event_date").saveAsTable(f"{database}.readings")
    return readings.newest_of_sensor(t.spark, f"{database}.readings", "s-10", "3", 5).select("event_id", "event_time", "metrics")


@query("ord3_result_limit", """
SELECT CAST(event_id AS STRING) AS event_id, sensor_id FROM readings WHERE tenant_id = '1'
ORDER BY readings.event_id LIMIT 1000""")
def result_limit(t):
    return tenant_console(t, 1).run("SELECT event_id, sensor_id FROM readings ORDER BY event_id")


@query("ord4_sensors_by_cost", f"""
SELECT sensor_id, round(messages * 0.0005e0 + {_STORED} / 1024e0 * (0.50e0 / 1048576), 6) AS total_cost, messages,
  {_STORED} AS stored_bytes FROM {_OVERLAID} x""")
def sensors_by_cost(t):
    rows = metering.with_costs(overlaid(t)).orderBy(F.desc("total_cost"), "sensor_id")
    return rows.select("sensor_id", F.round("total_cost", 6).alias("total_cost"), "messages", "stored_bytes")


@query("ord5_usage_oldest_first", """
SELECT billing_id, id, created_at, amount FROM ledger WHERE type = 'usage' ORDER BY billing_id, created_at, id""")
def usage_oldest_first(t):
    rows = t.ledger.filter("type = 'usage'")
    return rows.orderBy("billing_id", "created_at", "id").select("billing_id", "id", "created_at", "amount")


@query("set1_replace_role", """
SELECT tenant_id, user_id, role_id FROM (SELECT CAST(c_nationkey AS STRING) AS tenant_id, c_custkey AS user_id,
    c_nationkey AS role_id FROM customer) a WHERE user_id NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT CAST(c_nationkey AS STRING), c_custkey, (c_nationkey + 1) % 25 FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def replace_role(t):
    customer = t.table("customer")
    assigned = customer.select(F.col("c_nationkey").cast("string").alias("tenant_id"),
                               F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("role_id"))
    buyers = t.table("orders").select(F.col("o_custkey").alias("user_id"))
    updates = assigned.join(buyers, "user_id", "left_semi").withColumn("role_id", (F.col("role_id") + 1) % 25)
    return registry.replace_role(assigned, updates)


@query("set2_newest_token", f"""
SELECT token_id, user_id, used OR row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, token_id DESC) > 1
  AS used FROM {TOKENS} k""")
def newest_token(t):
    return registry.keep_newest_token(tokens(t)).select("token_id", "user_id", "used")
