"""Streaming-only operators, run over what the source holds."""

from pyspark.sql import functions as F

from loam import bindings
from loam.catalogue import query
from loam.catalogue.aggregates import windowed
from loam.catalogue.sources import _ACCEPTED, _CLOSED, _TYPE, ingested, new_lake
from loam.operators import account_history, billing
from loam.session import scratch
from loam.sources import streams
from loam.streaming import billing_log, counters, ingest, runs, windows


@query("str1_watermark", f"SELECT * FROM ({windowed('tenant_id')}) w {_CLOSED}")
def watermark(t):
    """Append mode: only windows the watermark has passed come out."""
    return runs.append_now(windows.closed_sliding_counts(t.streamed("readings"), ["tenant_id"]), "str1")


@query("str2_sliding_window", windowed("sensor_type"))
def sliding_window(t):
    """Update mode: every window with its latest count."""
    counts = windows.sliding_counts(t.streamed("readings"), ["sensor_type"])
    return runs.update_now(counts, ["window_start", "window_end", "sensor_type"], "str2")


_LATE = """(SELECT r.* FROM readings r, (SELECT date_trunc('millisecond', max(event_time)) - INTERVAL 10 MINUTE AS mark
  FROM readings WHERE farm_id NOT IN ('f-7', 'f-8')) m
WHERE r.farm_id <> 'f-7' OR time_bucket(INTERVAL 15 SECOND, r.event_time, TIMESTAMP '1970-01-01') + INTERVAL 15 SECOND > m.mark)"""


@query("str3_late_rows", f"SELECT * FROM ({windowed('farm_id').replace('readings', _LATE)}) w {_CLOSED}")
def late_rows(t):
    """The readings of two farms come in a second and a third file, after all others.

    A batch drops what the watermark of the batch before had passed. So those of the third
    file are dropped whose pane lies before the mark of the first; the rest is counted.
    """
    root = scratch(t.spark, "str3")
    farm = F.col("farm_id")
    for nth, farm in enumerate((~farm.isin("f-7", "f-8"), farm == "f-8", farm == "f-7")):
        t.readings.filter(farm).coalesce(1).write.parquet(f"{root}/in/part={nth}")
    stream = streams.file_stream(t.spark, f"{root}/in/*", t.readings.schema, files_per_trigger=1)
    return runs.append_now(windows.closed_sliding_counts(stream, ["farm_id"]), "str3")


@query("str4_ingest_by_type", f"SELECT {_TYPE} AS sensor_type, count(*) AS n {_ACCEPTED} GROUP BY 1")
def ingest_by_type(t):
    rows = t.spark.table(ingested(t, "str4").readings)
    return rows.groupBy("sensor_type").agg(F.count(F.lit(1)).alias("n"))


@query("str5_restart", f"SELECT {_TYPE} AS sensor_type, count(*) AS n {_ACCEPTED} GROUP BY 1")
def restart(t):
    """A second start from the same checkpoint finds nothing new."""
    target, state = new_lake(t, "str5"), scratch(t.spark, "str5-state")
    for _ in range(2):
        ingest.ingest(t.streamed("messages"), target, state, None).awaitTermination()
    return t.spark.table(target.readings).groupBy("sensor_type").agg(F.count(F.lit(1)).alias("n"))


@query("str6_bounded_batches", """
SELECT CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week, count(*) AS n, 1 AS batches FROM events GROUP BY 1""")
def bounded_batches(t):
    """One file per week of events, one file per micro-batch."""
    root = scratch(t.spark, "str6")
    week = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 604800)
    weekly = t.table("events").withColumn("week", week)
    weeks = weekly.select("week").distinct().count()
    weekly.repartitionByRange(weeks, "week").write.parquet(f"{root}/in")
    stream = streams.file_stream(t.spark, f"{root}/in", weekly.schema, files_per_trigger=1)
    writer = stream.writeStream.foreachBatch(runs.changelog(f"{root}/out"))
    runs.start(writer, f"{root}/state", None).awaitTermination()
    return t.spark.read.parquet(f"{root}/out").groupBy("week").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("_batch").cast("int").alias("batches"))


@query("str7_dead_letter_table", """
SELECT topic AS raw_topic, partition AS _partition, "offset" AS _offset, value,
  CASE WHEN topic IN ('iot.7', 'iot.a.b.c') THEN 'bad_topic' ELSE 'bad_json' END AS reject_reason
FROM messages WHERE topic IN ('iot.7', 'iot.a.b.c') OR value = 'not json'""")
def dead_letter_table(t):
    return t.spark.table(ingested(t, "str7").dead_letters).drop("commit_id", "arrival_date")


FILE_ROWS = 50_000
"""Messages of one file at most: a file has one row group, which one task reads and parses."""


def newest_first(t, purpose, run, parts=3):
    """Hands all messages to a stream in parts, one a start, the latest times first, an empty one between.

    A part is what has come in since the last start; it is written and read in parallel, in
    as many files as its rows ask for: texts pack so well that their bytes would make few.
    """
    root = scratch(t.spark, purpose)
    messages = t.messages.drop("event_id").withColumn("value", F.col("value").cast("binary"))
    times = messages.agg(F.min(F.unix_seconds("timestamp")), F.max(F.unix_seconds("timestamp"))).first()
    step = (times[1] - times[0]) // parts + 1
    part = F.floor((F.unix_seconds("timestamp") - times[0]) / step)
    for nth in [*range(parts - 1, 0, -1), parts, 0]:  # no message falls into the last part but one
        messages.filter(part == nth).write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{root}/in/part={nth}")
        run(streams.file_stream(t.spark, f"{root}/in/*", messages.schema))


@query("str9_replayed_messages", f"""
SELECT CAST(e.user_id % 7 AS STRING) AS tenant_id, count(*) AS n {_ACCEPTED} GROUP BY 1""")
def replayed_messages(t):
    """Every message arrives twice, the newest days first, and the sink is called twice for each batch."""
    target, state = new_lake(t, "str9"), scratch(t.spark, "str9-state")
    write = ingest.write_batch(target)

    def write_again(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    def run(part):
        twice = part.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
        runs.start(twice.writeStream.foreachBatch(write_again), state, None).awaitTermination()
    newest_first(t, "str9", run)
    return t.spark.table(target.readings).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


@query("str10_running_counters", """
SELECT tenant_id, sensor_id, CAST(sum(increment) AS BIGINT) AS message_count, max(event_time) AS last_message_at
FROM readings GROUP BY 1, 2""")
def running_counters(t):
    counted = counters.message_counters(t.streamed("readings"), ["tenant_id", "sensor_id"])
    return runs.update_now(counted, ["tenant_id", "sensor_id"], "str10")


_FOLD = """
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY happened_at, id) AS rn,
  count(*) OVER (PARTITION BY tenant_id) AS total FROM account_events),
f(tenant_id, rn, status, balance, due, messages, sensors, last_id, left_over) AS (
  SELECT tenant_id, CAST(0 AS BIGINT), 'active', 0e0, 0e0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS BIGINT), max(total)
  FROM e GROUP BY tenant_id
  UNION ALL
  SELECT tenant_id, rn, CASE kind WHEN 'topup' THEN 'active'
      WHEN 'cycle' THEN CASE WHEN nb <= 0 THEN 'suspended' ELSE 'active' END
      ELSE CASE WHEN status = 'active' AND nd > nb THEN 'suspended' ELSE status END END,
    nb, nd, nm, ns, id, left_over - 1
  FROM (SELECT *, CASE kind WHEN 'cycle' THEN 0e0 WHEN 'topup' THEN due
      WHEN 'query' THEN CASE WHEN status = 'active' THEN due + amount ELSE due END
      ELSE CASE WHEN status = 'active' THEN nm * (0.10e0 / 100000) + ns * 1.0e0 ELSE due END END AS nd
    FROM (SELECT f.tenant_id, e.rn, f.status, f.due, f.left_over, e.kind, e.amount, e.id,
        CASE e.kind WHEN 'topup' THEN f.balance + e.amount WHEN 'cycle' THEN f.balance - least(f.due, f.balance)
          ELSE f.balance END AS nb,
        CASE e.kind WHEN 'cycle' THEN 0 WHEN 'messages' THEN f.messages + e.quantity ELSE f.messages END AS nm,
        CASE e.kind WHEN 'sensors' THEN greatest(0, f.sensors + e.quantity) ELSE f.sensors END AS ns
      FROM f JOIN e ON e.tenant_id = f.tenant_id AND e.rn = f.rn + 1) a) b)
SELECT tenant_id, status, round(balance, 6) AS balance, round(due, 6) AS amount_due, messages AS message_count,
  sensors AS sensor_count, last_id FROM f WHERE left_over = 0"""


@query("str11_billing_fold", _FOLD)
def folded_billing(t):
    path = scratch(t.spark, "str11")
    billing_log.record_events(t.streamed("account_events"), f"{path}/events", f"{path}/state", None).awaitTermination()
    return billing_log.billing_states(t.spark, f"{path}/events").withColumn("balance", F.round("balance", 6)) \
        .withColumn("amount_due", F.round("amount_due", 6))


@query("str11_billing_history", _FOLD)
def billing_history(t):
    states = account_history.account_states(t.account_events)
    return states.withColumn("balance", F.round("balance", 6)) \
        .withColumn("amount_due", F.round("amount_due", 6))


@query("str8_empty_batches", f"SELECT {_TYPE} AS sensor_type, count(*) AS n {_ACCEPTED} GROUP BY 1")
def empty_batches(t):
    """Late files and an empty one: every message is kept, the empty batch writes nothing."""
    target, state = new_lake(t, "str8-lake"), scratch(t.spark, "str8-state")
    newest_first(t, "str8", lambda part: ingest.ingest(part, target, state, None).awaitTermination())
    return t.spark.table(target.readings).groupBy("sensor_type").agg(F.count(F.lit(1)).alias("n"))


@query("udf3_batch_callback", """
SELECT sensor_type, tenant_id, count(*) AS n, round(sum(value), 4) AS total FROM readings GROUP BY 1, 2""")
def batch_callback(t):
    """Micro-batches handed to a Python callback that writes each of them once."""
    path = scratch(t.spark, "udf3")
    writer = t.streamed("readings").writeStream.foreachBatch(runs.changelog(f"{path}/rows"))
    runs.start(writer, f"{path}/state", None).awaitTermination()
    return t.spark.read.parquet(f"{path}/rows").groupBy("sensor_type", F.col("tenant_id").cast("string").alias("tenant_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("str12_budget_deactivation", """
WITH c AS (SELECT r.sensor_id, r.event_id, r.event_time, s.budget, sum(r.increment) OVER (PARTITION BY r.sensor_id
    ORDER BY r.event_time, r.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS messages
  FROM readings r JOIN sensors s ON r.sensor_id = s.sensor_id WHERE s.status = 'active' AND s.budget > 0)
SELECT sensor_id, arg_min(event_id, (event_time, event_id)) AS event_id, min(event_time) AS event_time,
  CAST(arg_min(messages, (event_time, event_id)) AS BIGINT) AS messages,
  round(arg_min(messages, (event_time, event_id)) * 0.0005e0, 6) AS cost, any_value(budget) AS budget, 'inactive' AS status
FROM c WHERE messages * 0.0005e0 >= budget GROUP BY sensor_id""")
def budget_deactivation(t):
    return billing.deactivate_over_budget(t.readings, t.sensors).withColumn("cost", F.round("cost", 6))


@query("str12_budget_stream", """
SELECT s.sensor_id, s.budget, 'inactive' AS status FROM sensors s JOIN (
  SELECT sensor_id, sum(increment) AS messages FROM readings GROUP BY 1) r ON s.sensor_id = r.sensor_id
WHERE s.status = 'active' AND s.budget > 0 AND r.messages * 0.0005e0 >= s.budget""")
def budget_stream(t):
    reached = counters.first_crossings(t.streamed("readings"), t.sensors)
    return runs.append_now(reached, "str12").select("sensor_id", "budget", "status")  # a row for each sensor, ever
