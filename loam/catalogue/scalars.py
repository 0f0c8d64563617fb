"""Scalar functions over the bound frames."""

from pyspark.sql import functions as F

from loam import bindings, schemas
from loam.catalogue import query
from loam.catalogue.projections import flagged_sensors
from loam.functions import envelope as E
from loam.functions import money, records
from loam.operators import billing, farms, metering, readings, registry

NOW = bindings.NOW


def at(text):
    return F.lit(text).cast("timestamp")


@query("sc1_iso_timestamp", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', event_time) END AS parsed FROM readings""")
def iso_timestamp(t):
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(F.col("event_id") % 3 == 0, F.concat(stamp, F.lit("Z")))
            .when(F.col("event_id") % 3 == 1, F.concat(stamp, F.lit(".123Z"))).otherwise("soon"))
    return t.readings.select("event_id", E.iso_timestamp(text).alias("parsed"))


@query("sc2_calendar_parts", """
SELECT event_id, CAST(year(event_time) AS INT) AS year, CAST(month(event_time) AS INT) AS month,
  CAST(day(event_time) AS INT) AS day, CAST(hour(event_time) AS INT) AS hour FROM readings""")
def calendar_parts(t):
    parts = E.calendar_parts(F.col("event_time"))
    return t.readings.select("event_id", *[c.alias(n) for n, c in parts.items()])


@query("sc3_utc_timestamp", """
SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL
  WHEN 2 THEN date_trunc('second', event_time) - INTERVAL 1 HOUR
  ELSE date_trunc('second', event_time) END AS parsed FROM readings""")
def utc_timestamp(t):
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    text = (F.when(kind == 0, stamp).when(kind == 1, F.concat(stamp, F.lit("Z")))
            .when(kind == 2, F.concat(stamp, F.lit("+01:00"))).otherwise("no time"))
    return t.readings.select("event_id", E.utc_timestamp(text).alias("parsed"))


@query("sc4_age_label", f"""
SELECT event_id, CASE WHEN s < 5 THEN 'just now' WHEN s < 60 THEN concat(CAST(s AS STRING), 's ago')
  WHEN s < 3600 THEN concat(CAST(s // 60 AS STRING), 'm ago')
  WHEN s < 86400 THEN concat(CAST(s // 3600 AS STRING), 'h ago')
  ELSE concat(CAST(s // 86400 AS STRING), 'd ago') END AS age
FROM (SELECT event_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(event_time)) // 1000000 AS s FROM readings) x""")
def age_label(t):
    return t.readings.select("event_id", E.age_label(F.col("event_time"), at(NOW)).alias("age"))


@query("sc5_next_due", """
SELECT billing_id, id, CASE billing_id % 6 WHEN 0 THEN created_at + INTERVAL 1 DAY
  WHEN 1 THEN created_at + INTERVAL 7 DAY WHEN 2 THEN created_at + INTERVAL 1 MONTH
  WHEN 3 THEN created_at + INTERVAL 3 MONTH WHEN 4 THEN created_at + INTERVAL 1 YEAR
  ELSE created_at END AS due_date FROM ledger""")
def next_due(t):
    names = F.array(*[F.lit(x) for x in ("daily", "weekly", "monthly", "quarterly", "yearly", "never")])
    frequency = F.get(names, (F.col("billing_id") % 6).cast("int"))
    return t.ledger.select("billing_id", "id",
                           money.next_due(frequency, F.col("created_at")).alias("due_date"))


@query("sc6_period_key", "SELECT id, strftime(created_at, '%Y-%m') AS period FROM ledger")
def period_key(t):
    return t.ledger.select("id", money.period_key(F.col("created_at")).alias("period"))


@query("sc7_days_to_harvest", """
SELECT crop_id, crop_name, d AS days_to_harvest,
  CASE WHEN d < 0 THEN 'overdue' WHEN d <= 14 THEN 'soon' ELSE 'ok' END AS label
FROM (SELECT crop_id, crop_name, CAST(ceil((epoch(CAST(expected_harvest_date AS TIMESTAMP))
  - epoch(TIMESTAMP '2024-01-20 09:30:00')) / 86400.0) AS BIGINT) AS d FROM crops) x""")
def days_to_harvest(t):
    return farms.harvest_schedule(t.crops, "2024-01-20 09:30:00").select(
        "crop_id", "crop_name", "days_to_harvest", "label")


@query("sc8_harvest_countdown", """
SELECT crop_id, crop_name, d AS growing_days,
  CASE WHEN d <= 30 THEN 'red' WHEN d <= 60 THEN 'orange' WHEN d <= 90 THEN 'amber' ELSE 'emerald' END AS urgency,
  round(least(d / 365.0 * 100, 100), 6) AS season_pct
FROM (SELECT crop_id, crop_name, CASE lower(crop_name) WHEN 'maize' THEN 90 WHEN 'lettuce' THEN 45
  WHEN 'cassava' THEN 270 WHEN 'tomato' THEN 75 ELSE 90 END AS d FROM crops) x""")
def harvest_countdown(t):
    return farms.harvest_countdown(t.crops.withColumn("crop", F.col("crop_name"))).select(
        "crop_id", "crop_name", "growing_days", "urgency", F.round("season_pct", 6).alias("season_pct"))


_QU = """round(greatest(1.0e0, processed_bytes / 1073741824e0 + cpu_ms / 1000e0 * 2
  + peak_mem_bytes / 1073741824e0 * (wall_ms / 1000e0) * 0.5e0), 4)"""


@query("sc9_query_units", f"SELECT query_id, tenant_id, {_QU} AS qu FROM query_stats")
def query_units(t):
    return metering.with_query_cost(t.query_stats).select("query_id", "tenant_id", "qu")


@query("sc10_query_cost", f"""
SELECT query_id, qu, round(qu * 0.01e0, 6) AS cost FROM (SELECT query_id, {_QU} AS qu FROM query_stats) x""")
def query_cost(t):
    return metering.with_query_cost(t.query_stats).select("query_id", "qu", "cost")


@query("sc11_data_points", f"""
SELECT query_id, half, CAST(round_even(qu, 0) AS INT) AS data_points, CAST(round_even(half, 0) AS INT) AS half_points
FROM (SELECT query_id, {_QU} AS qu, l AS half FROM (SELECT *, user_id + 0.5e0 AS l FROM query_stats) y) x""")
def data_points(t):
    rows = metering.with_query_cost(t.query_stats).withColumn("half", F.col("user_id") + F.lit(0.5))
    return rows.select("query_id", "half", "data_points",
                       money.data_points(F.col("half")).alias("half_points"))


@query("sc12_message_cost", """
SELECT sensor_id, round(message_count * 0.0005e0, 6) AS message_cost FROM sensors""")
def message_cost(t):
    return t.sensors.select("sensor_id", F.round(money.message_cost(F.col("message_count")), 6)
                            .alias("message_cost"))


_STORED = "CASE WHEN storage_bytes > 0 THEN storage_bytes ELSE message_count * 300 END"


@query("sc13_stored_bytes", f"SELECT sensor_id, {_STORED} AS stored_bytes FROM sensors")
def stored_bytes(t):
    return t.sensors.select("sensor_id", money.stored_bytes(
        F.col("storage_bytes"), F.col("message_count")).alias("stored_bytes"))


@query("sc14_storage_cost", f"""
SELECT sensor_id, round(b / 1024e0, 6) AS kb, round(b / 1048576e0, 6) AS mb, round(b / 1073741824e0, 9) AS gb,
  round(b / 1024e0 * (0.50e0 / (1024 * 1024)), 9) AS storage_cost
FROM (SELECT sensor_id, {_STORED} AS b FROM sensors) x""")
def storage_cost(t):
    rows = t.sensors.withColumn("b", money.stored_bytes(F.col("storage_bytes"), F.col("message_count")))
    return rows.select("sensor_id", F.round(F.col("b") / money.KB, 6).alias("kb"),
                       F.round(F.col("b") / money.MB, 6).alias("mb"),
                       F.round(F.col("b") / money.GB, 9).alias("gb"),
                       F.round(money.storage_cost(F.col("b")), 9).alias("storage_cost"))


@query("sc15_allocation_use", f"""
SELECT sensor_id, storage_id, allocated_gb, cost, round(pct, 6) AS used_pct,
  CASE WHEN pct >= 90 THEN 'red' WHEN pct >= 70 THEN 'orange' ELSE 'emerald' END AS band
FROM (SELECT a.sensor_id, a.storage_id, a.allocated_gb, round(a.allocated_gb * 0.50e0, 9) AS cost,
  CASE WHEN a.allocated_gb > 0 THEN least({_STORED} / (a.allocated_gb * 1073741824e0) * 100, 100) ELSE 0e0 END AS pct
  FROM allocations a JOIN sensors s ON a.sensor_id = s.sensor_id) x""")
def allocation_use(t):
    rows = metering.storage_usage(t.sensors.withColumn("messages", F.col("message_count")), t.allocations)
    return rows.filter("storage_id IS NOT NULL").select(
        "sensor_id", "storage_id", "allocated_gb",
        F.round(F.col("allocated_gb") * schemas.PRICES.storage_gb, 9).alias("cost"),
        F.round("used_pct", 6).alias("used_pct"), "band")


@query("sc16_budget_percent", """
SELECT sensor_id, round(pct, 6) AS budget_pct,
  CASE WHEN pct >= 100 THEN 'critical' WHEN pct >= 80 THEN 'warning' ELSE 'ok' END AS level
FROM (SELECT sensor_id, CASE WHEN budget > 0 THEN message_count * 0.0005e0 / budget * 100 END AS pct FROM sensors) x""")
def budget_percent(t):
    pct = money.budget_percent(money.message_cost(F.col("message_count")), F.col("budget"))
    return t.sensors.withColumn("pct", pct).select(
        "sensor_id", F.round("pct", 6).alias("budget_pct"), money.budget_level(F.col("pct")).alias("level"))


_CARD = """concat(CASE c_custkey % 7 WHEN 0 THEN '4' WHEN 1 THEN '51' WHEN 2 THEN '55' WHEN 3 THEN '56'
  WHEN 4 THEN '34' WHEN 5 THEN '37' ELSE '6011' END, '00 1111 ', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))"""
_BRAND = """CASE c_custkey % 7 WHEN 0 THEN 'Visa' WHEN 1 THEN 'Mastercard' WHEN 2 THEN 'Mastercard'
  WHEN 4 THEN 'Amex' WHEN 5 THEN 'Amex' ELSE 'Card' END"""
_METHOD = """CASE c_custkey % 8 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'paypal' WHEN 2 THEN 'skrill'
  WHEN 3 THEN 'revolut' WHEN 4 THEN 'bank_transfer' WHEN 5 THEN 'apple_pay' WHEN 6 THEN 'bank_transfer'
  ELSE 'paypal' END"""


@query("sc17_card_brand", f"""
SELECT c_custkey, {_BRAND} AS brand, lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS last4 FROM customer""")
def card_brand(t):
    rows = t.table("customer").selectExpr("c_custkey", f"{_CARD} AS card")
    return rows.select("c_custkey", money.card_brand(money.card_digits(F.col("card"))).alias("brand"),
                       money.card_last4(F.col("card")).alias("last4"))


@query("sc18_topup_text", f"""
SELECT c_custkey, CASE c_custkey % 8
  WHEN 0 THEN concat('Top-up via ', {_BRAND}, ' ending ', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))
  WHEN 1 THEN concat('Top-up via PayPal (', lower(c_name), '@x.org)')
  WHEN 2 THEN concat('Top-up via Skrill (', lower(c_name), '@x.org)')
  WHEN 3 THEN concat('Top-up via Revolut (', lower(c_name), '@x.org)')
  WHEN 4 THEN concat('Top-up via Wire Transfer (ref: W', CAST(c_custkey AS STRING), ')')
  WHEN 5 THEN 'Top-up via Apple Pay' WHEN 6 THEN 'Top-up via Wire Transfer (ref: N/A)'
  ELSE 'Top-up via Paypal' END AS description FROM customer""")
def topup_text(t):
    rows = t.table("customer").selectExpr(
        "c_custkey", f"{_CARD} AS card", f"{_METHOD} AS method",
        "CASE WHEN c_custkey % 8 < 7 THEN concat(lower(c_name), '@x.org') END AS payer",
        "CASE WHEN c_custkey % 8 = 4 THEN concat('W', CAST(c_custkey AS STRING)) ELSE '' END AS reference")
    return rows.select("c_custkey", money.topup_text(*map(F.col, ("method", "card", "payer", "reference")))
                       .alias("description"))


@query("sc19_charge_text", f"""
SELECT query_id, concat('Query — ', printf('%.2f', qu), ' QU · ', substr(sql, 1, 120)) AS charge,
  concat('Billing cycle charge — ', format('{{:,}}', query_id * 37), ' messages') AS cycle
FROM (SELECT query_id, sql, {_QU} AS qu FROM query_stats) x""")
def charge_text(t):
    rows = metering.with_query_cost(t.query_stats)
    return rows.select("query_id", money.charge_text(F.col("qu"), F.col("sql")).alias("charge"),
                       money.cycle_text(F.col("query_id") * 37).alias("cycle"))


@query("sc20_display_name", """
SELECT user_id, coalesce(first_name, split_part(email, '@', 1)) AS name,
  coalesce(first_name, concat('User #', CAST(user_id AS STRING))) AS actor FROM users""")
def display_name(t):
    return t.users.select("user_id", records.display_name(F.col("first_name"), F.col("email")).alias("name"),
                          records.actor_name(F.col("first_name"), F.col("user_id")).alias("actor"))


def _map_text(column):
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query("sc21_metadata_overlay", """
SELECT sensor_id, nullif(concat_ws(';', manufacturer, model, power), '') AS metadata FROM (
  SELECT sensor_id,
    CASE message_count % 3 WHEN 0 THEN 'manufacturer=Acme' WHEN 1 THEN 'manufacturer=Old' END AS manufacturer,
    CASE WHEN message_count % 2 = 0 THEN concat('model=', farm_id) ELSE 'model=m0' END AS model,
    CASE WHEN message_count % 5 = 0 THEN 'power_type=solar' END AS power FROM sensors) x""")
def metadata_overlay(t):
    n = F.col("message_count")
    base = F.create_map(F.lit("manufacturer"), F.lit("Old"), F.lit("model"), F.lit("m0"))
    updates = F.create_map(
        F.lit("manufacturer"), F.when(n % 3 == 0, " Acme ").when(n % 3 == 2, "  "),
        F.lit("model"), F.when(n % 2 == 0, F.col("farm_id")),
        F.lit("power_type"), F.when(n % 5 == 0, "solar"))
    return t.sensors.select("sensor_id", _map_text(records.overlay(base, updates)).alias("metadata"))


@query("sc22_metadata_key", """
SELECT sensor_id, concat(CASE WHEN contains(sensor_id, '7') THEN 'billing_suspended=true;' ELSE '' END,
    'budget=', CAST(message_count AS STRING), ';model=m-', farm_id) AS with_budget,
  concat('model=m-', farm_id) AS without_flag FROM sensors""")
def metadata_key(t):
    rows = flagged_sensors(t)
    return rows.select("sensor_id", _map_text(records.with_key(
        F.col("metadata"), "budget", F.col("message_count").cast("string"))).alias("with_budget"),
        _map_text(records.without_key(F.col("metadata"), "billing_suspended")).alias("without_flag"))


@query("sc23_address", """
SELECT farm_id, coalesce(nullif(concat_ws(', ', nullif(address, ''), nullif(country, '')), ''), '—') AS address
FROM farms""")
def address(t):
    return t.farms.select("farm_id", records.joined_address(F.col("address"), F.col("country")).alias("address"))


@query("sc24_farm_crops", "SELECT farm_id, tenant_id, farm_name, unnest(crops) AS crop FROM farms")
def farm_crops(t):
    return farms.farm_crops(t.farms)


@query("sc25_crop_history", """
SELECT farm_id, y + 2000 AS year, concat_ws('|', 'Maize', concat('Crop ', CAST(y AS STRING))) AS crops,
  CASE WHEN y % 2 = 0 THEN y * 1.5e0 END AS yield_tons
FROM (SELECT farm_id, CAST(length(farm_name) + CAST(floor(farm_size_ha) AS BIGINT) % 20 AS INT) AS y FROM farms) x
WHERE y % 3 <> 0 AND y % 5 <> 0""")
def crop_history(t):
    y = (F.length("farm_name") + F.floor("farm_size_ha") % 20).cast("int")
    row = F.struct(
        F.when(F.col("y") % 3 == 0, "").otherwise((F.col("y") + 2000).cast("string")).alias("year"),
        F.when(F.col("y") % 5 == 0, "").otherwise(
            F.concat(F.lit("Maize ,  Crop "), F.col("y").cast("string"))).alias("crops"),
        F.when(F.col("y") % 2 == 0, (F.col("y") * 1.5).cast("string")).otherwise("").alias("yield_tons"))
    rows = t.farms.withColumn("y", y).select(
        "farm_id", F.explode(records.history_entries(F.array(row))).alias("h"))
    return rows.select("farm_id", "h.year", F.array_join("h.crops", "|").alias("crops"), "h.yield_tons")


@query("sc27_millis_timestamp", "SELECT event_id, date_trunc('millisecond', event_time) AS event_time FROM readings")
def millis_timestamp(t):
    millis = F.unix_millis("event_time")
    return t.readings.select("event_id", F.timestamp_millis(millis).alias("event_time"))


@query("sc28_topic_paths", """
SELECT DISTINCT raw_topic, concat(replace(raw_topic, '.', '/'), '/data') AS path, raw_topic AS back,
  concat(replace(raw_topic, '.', '__'), '__data') AS encoded,
  concat(replace(raw_topic, '.', '/'), '/data') AS decoded FROM readings""")
def topic_paths(t):
    path = F.col("path")
    rows = t.readings.select("raw_topic").distinct().withColumn("path", E.path_of_topic(F.col("raw_topic")))
    return rows.select("raw_topic", "path", E.topic_of_path(path).alias("back"),
                       E.encode_path(path).alias("encoded"),
                       E.decode_path(E.encode_path(path)).alias("decoded"))


@query("sc29_page_count", """
SELECT billing_id, count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages
FROM ledger GROUP BY billing_id""")
def page_count(t):
    totals = t.ledger.groupBy("billing_id").agg(F.count(F.lit(1)).alias("total"))
    return totals.withColumn("pages", records.page_count(F.col("total"), 20))


@query("sc30_storage_residual", """
SELECT id, round(greatest(0e0, amount - data_points * 0.0005e0 - id % 30), 6) AS storage FROM ledger""")
def storage_residual(t):
    residual = money.storage_residual(F.col("amount"), money.message_cost(F.col("data_points")), F.col("id") % 30)
    return t.ledger.select("id", F.round(residual, 6).alias("storage"))


@query("sc31_rates", """
SELECT n_nationkey AS tenant_id, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 1000e0 ELSE 0.0005e0 END AS message_rate,
  CASE WHEN n_nationkey % 3 = 0 THEN 0.75e0 ELSE 0.50e0 END AS storage_rate,
  CASE WHEN n_nationkey % 5 = 0 THEN 0.02e0 ELSE 0.01e0 END AS query_rate FROM nation""")
def rates(t):
    k = F.col("n_nationkey")
    overrides = t.table("nation").select(
        k.alias("tenant_id"), F.when(k % 2 == 0, k / F.lit(1000.0)).alias("message_rate"),
        F.when(k % 3 == 0, 0.75).alias("storage_rate"), F.when(k % 5 == 0, 0.02).alias("query_rate"))
    return billing.effective_rates(overrides)


@query("sc32_crop_chips", """
SELECT farm_id, array_to_string(crops[1:3], '|') AS shown, CAST(greatest(len(crops) - 3, 0) AS INT) AS hidden FROM farms""")
def crop_chips(t):
    return farms.crop_chips(t.farms).withColumn("shown", F.array_join("shown", "|"))


@query("sc33_lenient_number", """
SELECT sensor_id, CASE message_count % 3 WHEN 0 THEN message_count / 100e0 ELSE 0e0 END AS latitude FROM sensors""")
def lenient_number(t):
    n = F.col("message_count")
    text = F.when(n % 3 == 0, (n / F.lit(100.0)).cast("string")).when(n % 3 == 1, "north")
    return t.sensors.select("sensor_id", records.lenient_number(text).alias("latitude"))


@query("sc34_step_events", """
SELECT sensor_id, e AS event_type, CASE WHEN s = 'success' THEN 'success' WHEN s = 'skipped' THEN 'pending'
  ELSE 'failed' END AS status, concat(s, ' at ', sensor_id) AS message
FROM (SELECT sensor_id, unnest(['kafka_topic_created', 'mqtt_topic_created', 'simulator_started']) AS e,
  unnest([CASE WHEN message_count % 2 = 0 THEN 'success' ELSE 'skipped' END,
          CASE WHEN message_count % 3 = 0 THEN 'error' ELSE 'success' END,
          CASE WHEN message_count % 5 > 0 THEN 'success' END]) AS s FROM sensors) x WHERE s IS NOT NULL""")
def step_events(t):
    n = F.col("message_count")
    def step(status):
        return F.struct(status.alias("status"), F.concat(status, F.lit(" at "), F.col("sensor_id")).alias("message"))
    steps = F.create_map(
        F.lit("kafka_topic_created"), step(F.when(n % 2 == 0, "success").otherwise("skipped")),
        F.lit("mqtt_topic_created"), step(F.when(n % 3 == 0, "error").otherwise("success")),
        F.when(n % 5 > 0, "simulator_started").otherwise("other_step"), step(F.lit("success")))
    return registry.step_events(t.sensors.withColumn("steps", steps), schemas.SETUP_STEPS)


@query("sc35_hardware_view", """
SELECT s.sensor_id, coalesce(h.fw, 'v0') AS firmware, s.mac, CAST(NULL AS STRING) AS ip, h.battery,
  coalesce(h.memory, '?/64 MB') AS memory
FROM (SELECT sensor_id, concat('mac-', sensor_id) AS mac FROM sensors) s LEFT JOIN (
  SELECT sensor_id, arg_max(fw, k) AS fw, arg_max(battery, k) AS battery, arg_max(memory, k) AS memory FROM (
    SELECT r.sensor_id, concat('v', CAST(r.event_id % 9 AS STRING)) AS fw, CAST(r.event_id % 100 AS STRING) AS battery,
      concat(CAST(r.event_id % 64 AS STRING), '/128 MB') AS memory, (r.event_time, r.event_id) AS k
    FROM readings r JOIN messages m ON r.event_id = m.event_id
    WHERE m.value <> 'not json' AND r.event_id % 3 > 0 AND m.topic NOT IN ('iot.7', 'iot.a.b.c')) x GROUP BY sensor_id) h
  ON s.sensor_id = h.sensor_id""")
def hardware_view(t):
    good = t.messages.filter(E.topic_is_valid(F.col("topic")) & (F.col("topic") != "iot.a.b.c"))
    live = readings.latest_hardware(good).withColumn("sensor_id", E.topic_part(F.col("topic"), 2)).drop("topic")
    stored = F.create_map(F.lit("firmware_version"), F.lit("v0"), F.lit("mac_address"),
                          F.concat(F.lit("mac-"), F.col("sensor_id")), F.lit("memory"), F.lit("?/64 MB"))
    return registry.hardware_view(t.sensors.withColumn("metadata", stored), live)
