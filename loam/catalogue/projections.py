"""Message parsing, key and type derivation, filters."""

from pyspark.sql import functions as F

from loam import bindings, schemas
from loam.catalogue import query
from loam.functions import envelope as E
from loam.functions import money
from loam.operators import billing, console, readings, registry

ID = ["raw_topic", "_partition", "_offset"]
_KEYS = 'm.topic AS raw_topic, m.partition AS _partition, m."offset" AS _offset'
_GOOD = "m.value <> 'not json'"
_JOIN = "FROM messages m JOIN readings r ON m.event_id = r.event_id"


@query("prj1_envelope", f"""
SELECT {_KEYS}, CASE WHEN {_GOOD} THEN r.device_id END AS device_id,
  CASE WHEN {_GOOD} THEN r.farm_id END AS farm_id,
  CASE WHEN {_GOOD} THEN date_trunc('second', r.event_time) END AS event_time {_JOIN}""")
def envelope(t):
    return readings.parsed(t.messages).select(*ID, "device_id", "farm_id", "event_time")


@query("prj2_keys", f"""
SELECT {_KEYS}, CASE WHEN m.topic = 'iot.a.b.c' THEN 'a' WHEN m.topic = 'iot.7' THEN '7'
    ELSE r.tenant_id END AS tenant_id,
  CASE WHEN m.topic = 'iot.a.b.c' THEN 'b' WHEN m.topic = 'iot.7' AND NOT ({_GOOD}) THEN NULL
    ELSE r.sensor_id END AS sensor_id {_JOIN}""")
def keys(t):
    return readings.parsed(t.messages).select(*ID, "tenant_id", "sensor_id")


@query("prj3_dead_letters", f"""
SELECT {_KEYS}, m.value, CASE WHEN m.topic IN ('iot.7', 'iot.a.b.c') THEN 'bad_topic' ELSE 'bad_json' END
  AS reject_reason FROM messages m WHERE m.topic IN ('iot.7', 'iot.a.b.c') OR NOT ({_GOOD})""")
def dead_letters(t):
    return readings.dead_letters(readings.parsed(t.messages)).drop("arrival_date")


_CANON = """CASE e.event_type WHEN 'view' THEN 'soil' WHEN 'click' THEN 'co2' WHEN 'purchase' THEN 'weather'
  WHEN 'signup' THEN 'temperature' ELSE 'unknown' END"""


@query("prj4_sensor_type", f"""
SELECT {_KEYS}, CASE WHEN {_GOOD} THEN {_CANON} ELSE 'unknown' END AS sensor_type
FROM messages m JOIN events e ON m.event_id = e.event_id""")
def sensor_type(t):
    return readings.parsed(t.messages).select(*ID, "sensor_type")


@query("prj5_canonical_type", f"""
SELECT r.sensor_type AS raw_type, {_CANON} AS sensor_type, count(*) AS n
FROM readings r JOIN events e ON r.event_id = e.event_id GROUP BY 1, 2""")
def canonical_type(t):
    kind = E.canonical_type(F.col("sensor_type"))
    return (t.readings.groupBy(F.col("sensor_type").alias("raw_type"), kind.alias("sensor_type"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("prj6_metrics", f"""
SELECT {_KEYS}, CASE WHEN {_GOOD} AND e.event_type <> 'error' THEN replace(e.props, ' ', '') END AS metrics
FROM messages m JOIN events e ON m.event_id = e.event_id""")
def metrics(t):
    return readings.parsed(t.messages).select(*ID, "metrics")


@query("prj7_location", f"""
SELECT {_KEYS}, CASE WHEN {_GOOD} THEN
  concat('{{"latitude":', CAST(e.user_id % 90 AS STRING), ',"longitude":3}}') END AS location
FROM messages m JOIN events e ON m.event_id = e.event_id""")
def location(t):
    return readings.parsed(t.messages).select(*ID, "location")


@query("prj8_lake_rows", f"""
SELECT r.tenant_id, r.farm_id, r.sensor_id, r.device_id, date_trunc('second', r.event_time) AS event_time,
  concat('{{"latitude":', CAST(e.user_id % 90 AS STRING), ',"longitude":3}}') AS location,
  CASE WHEN e.event_type <> 'error' THEN replace(e.props, ' ', '') END AS metrics, m.topic AS raw_topic,
  CAST(year(e.ts) AS INT) AS year, CAST(month(e.ts) AS INT) AS month, CAST(day(e.ts) AS INT) AS day,
  CAST(hour(e.ts) AS INT) AS hour
{_JOIN} JOIN events e ON m.event_id = e.event_id
WHERE {_GOOD} AND m.topic NOT IN ('iot.7', 'iot.a.b.c')""")
def lake_rows(t):
    return readings.lake_rows(readings.parsed(t.messages))


@query("prj9_terminal_block", f"""
SELECT {_KEYS}, CASE WHEN {_GOOD} THEN replace(e.props, ' ', '') ELSE m.value END AS metrics
FROM messages m JOIN events e ON m.event_id = e.event_id""")
def terminal_block(t):
    return readings.with_terminal_block(t.messages).select(
        F.col("topic").alias("raw_topic"), F.col("partition").alias("_partition"),
        F.col("offset").alias("_offset"), "metrics")


_TYPES = list(schemas.METRIC_FIELDS)
_TYPED = " UNION ALL ".join(
    f"SELECT '{kind}' AS sensor_type, '{name}' AS metric, count(*) AS n, "
    + ("CAST(NULL AS DOUBLE)" if name in schemas.TEXT_METRICS else f"CAST(sum(event_id % {at + 7}) AS DOUBLE)")
    + f" AS total FROM readings WHERE event_id % {len(_TYPES)} = {nth}"
    for nth, kind in enumerate(_TYPES) for at, name in enumerate(schemas.METRIC_FIELDS[kind]))


@query("prj10_typed_metrics", _TYPED)
def typed_metrics(t):
    """The typed views of all nine types, each over the readings of its type."""
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("event_id") % len(_TYPES) + 1).cast("int"))
    block = F.coalesce(*[F.when(F.col("sensor_type") == k, F.to_json(F.struct(*[
        ((F.col("event_id") % (at + 7)).cast("string") if name in schemas.TEXT_METRICS else F.col("event_id") % (at + 7)).alias(name)
        for at, name in enumerate(names)]))) for k, names in schemas.METRIC_FIELDS.items()])
    rows = t.readings.withColumn("sensor_type", kind).withColumn("metrics", block)
    result = None
    for name, fields in schemas.METRIC_FIELDS.items():
        seen = readings.typed_metrics(rows, name).agg(F.array(*[F.struct(
            F.lit(f).alias("metric"), F.count(f).alias("n"),
            (F.lit(None) if f in schemas.TEXT_METRICS else F.sum(f)).cast("double").alias("total")) for f in fields]).alias("all"))
        seen = seen.select(F.lit(name).alias("sensor_type"), F.inline("all"))
        result = seen if result is None else result.unionByName(seen)
    return result


@query("prj11_stringified", """
SELECT CAST(l_orderkey AS STRING) AS l_orderkey, CAST(l_linenumber AS STRING) AS l_linenumber,
  CAST(l_quantity AS STRING) AS l_quantity, CAST(l_extendedprice AS STRING) AS l_extendedprice,
  l_returnflag, CAST(l_shipdate AS STRING) AS l_shipdate FROM lineitem""")
def stringified(t):
    return console.stringified(t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"))


def tenant_console(t, tenant):
    folder = t.folder
    return console.Console(t.spark, tenant, lambda session: {
        "readings": bindings.Tables(session, folder).readings,
        "nation": bindings.Tables(session, folder).table("nation")})


@query("flt1_tenant_scope", """
SELECT sensor_id, count(*) AS n FROM readings WHERE tenant_id = '3' GROUP BY sensor_id""")
def tenant_scope(t):
    return tenant_console(t, 3).query("SELECT sensor_id, count(*) AS n FROM readings GROUP BY sensor_id")


@query("flt2_parameters", """
SELECT event_id, event_time, metrics FROM readings WHERE sensor_id = 's-10' AND tenant_id = '3'""")
def parameters(t):
    return tenant_console(t, 3).query(
        "SELECT event_id, event_time, metrics FROM readings WHERE sensor_id = :sensor AND tenant_id = :tenant",
        {"sensor": "s-10", "tenant": "3"})


@query("flt3_tenant_function", """
SELECT sensor_type, count(*) AS n, round(sum(value), 4) AS total FROM readings
WHERE tenant_id = '5' GROUP BY sensor_type""")
def tenant_function(t):
    return tenant_console(t, 5).query(
        "SELECT sensor_type, count(*) AS n, round(sum(value), 4) AS total FROM readings "
        "WHERE tenant_id = CURRENT_USER_TENANT() GROUP BY sensor_type")


@query("udf2_tenant_macro", """
SELECT '4' AS tenant, farm_id, count(*) AS n FROM readings WHERE tenant_id = '4' GROUP BY farm_id""")
def tenant_macro(t):
    return tenant_console(t, 4).query(
        "SELECT current_user_tenant() AS tenant, farm_id, count(*) AS n FROM readings GROUP BY farm_id")


@query("flt4_clean_statement", """
SELECT farm_id, CAST(count(*) AS STRING) AS n FROM readings WHERE tenant_id = '2' GROUP BY farm_id""")
def clean_statement(t):
    return tenant_console(t, 2).run("  SELECT farm_id, count(*) AS n FROM readings GROUP BY farm_id ; ;")


@query("flt5_prefix", """
SELECT billing_id, CAST(count(*) FILTER (reference LIKE 'CYCLE-%') AS BIGINT) AS cycles,
  CAST(count(*) FILTER (reference LIKE 'QRY-%') AS BIGINT) AS queries FROM ledger GROUP BY billing_id""")
def prefix(t):
    return t.ledger.groupBy("billing_id").agg(
        F.count_if(F.col("reference").startswith("CYCLE-")).alias("cycles"),
        F.count_if(F.col("reference").startswith("QRY-")).alias("queries"))


@query("flt6_contains", """
SELECT id, description FROM ledger WHERE contains(lower(description), lower('s-12'))""")
def contains(t):
    return t.ledger.filter(F.lower("description").contains("s-12")).select("id", "description")


@query("flt7_search", """
SELECT sensor_id, sensor_name, sensor_type, location FROM sensors
WHERE contains(lower(sensor_name), 'ield 7') OR contains(lower(sensor_type), 'ield 7')
  OR contains(lower(coalesce(location, '')), 'ield 7')""")
def search(t):
    return registry.search(t.sensors, "iELD 7", ["sensor_name", "sensor_type", "location"]) \
        .select("sensor_id", "sensor_name", "sensor_type", "location")


@query("flt9_in_list", """
SELECT user_id, email FROM users WHERE user_id IN (SELECT performed_by FROM changes)""")
def in_list(t):
    actors = t.changes.select(F.col("performed_by").alias("user_id"))
    return t.users.join(actors, "user_id", "left_semi").select("user_id", "email")


_FLAG = "CASE WHEN contains(sensor_id, '7') THEN 'true' END"


def flagged_sensors(t):
    """Sensors with a metadata map; some carry the billing flag."""
    flag = F.when(F.col("sensor_id").contains("7"), F.lit("true"))
    pairs = F.create_map(F.lit("model"), F.concat(F.lit("m-"), F.col("farm_id")),
                         F.lit("billing_suspended"), flag)
    return t.sensors.withColumn("metadata", F.map_filter(pairs, lambda k, v: v.isNotNull()))


@query("flt11_status", f"""
SELECT tenant_id, CAST(count(*) FILTER (status = 'active') AS BIGINT) AS active,
  CAST(count(*) FILTER (status = 'error') AS BIGINT) AS error,
  CAST(count(*) FILTER (status = 'inactive' AND {_FLAG} = 'true') AS BIGINT) AS suspended
FROM sensors GROUP BY tenant_id""")
def status(t):
    flag = F.coalesce(F.try_element_at("metadata", F.lit("billing_suspended")) == "true", F.lit(False))
    return flagged_sensors(t).groupBy("tenant_id").agg(
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "error").alias("error"),
        F.count_if((F.col("status") == "inactive") & flag).alias("suspended"))


def tokens(t):
    """One reset token per order: a day of validity, some used."""
    return t.ledger.select(
        F.col("id").alias("token_id"), F.col("billing_id").alias("user_id"), "created_at",
        (F.col("created_at") + F.expr("INTERVAL 30 DAY")).alias("expires_at"),
        (F.col("type") == "debit").alias("used"))


TOKENS = """(SELECT id AS token_id, billing_id AS user_id, created_at,
  created_at + INTERVAL 30 DAY AS expires_at, type = 'debit' AS used FROM ledger)"""


@query("flt12_usable_tokens", f"""
SELECT token_id, user_id, expires_at FROM {TOKENS} k
WHERE expires_at > TIMESTAMP '{bindings.LEDGER_NOW}' AND NOT used""")
def usable_tokens(t):
    return registry.usable(tokens(t), bindings.LEDGER_NOW).select("token_id", "user_id", "expires_at")


@query("flt13_overdue", f"""
SELECT billing_id, due_date FROM billings WHERE due_date < TIMESTAMP '{bindings.NOW}'""")
def overdue(t):
    return billing.overdue(t.billings, bindings.NOW).select("billing_id", "due_date")


@query("flt14_budget_split", """
SELECT tenant_id, budget IS NOT NULL AS budgeted, count(*) AS n,
  CAST(sum(message_count) AS BIGINT) AS messages FROM sensors GROUP BY 1, 2""")
def budget_split(t):
    return t.sensors.groupBy("tenant_id", F.col("budget").isNotNull().alias("budgeted")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("message_count").alias("messages"))
