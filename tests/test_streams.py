"""Streams over hand-written files: late rows, replays, restarts, folds."""

import datetime
import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam import schemas
from loam.catalogue import streams as streaming_queries
from loam.operators import account_history, billing, readings
from loam.session import scratch
from loam.sources import lake, streams
from loam.streaming import billing_log, counters, ingest, runs, windows

READING = "event_time timestamp, tenant_id string"


def at(minute, hour=0):
    return datetime.datetime(2026, 1, 1, hour, minute)


def write(spark, folder, name, data, schema):
    """One file per call, later calls with later file times."""
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}")
    time.sleep(0.05)


def fresh_lake(spark):
    root = scratch(spark, "test-lake")
    return lake.Lake(spark, "t_" + root.rsplit("-", 1)[1], root).create()


def message(sensor, offset, minute=0, **changes):
    value = {"device_id": "d", "timestamp": f"2026-01-01T00:{minute:02d}:00Z", "farm_id": "f",
             "sensor_type": "soil", "soil_metrics": {"ph": 6.5}, **changes}
    return (f"iot.7.{sensor}", bytearray(json.dumps(value).encode()), 0, offset, at(minute))


def test_late_row_is_dropped(spark):
    """The engine drops by the watermark of the batch before, so one row follows 00:30 first."""
    folder = scratch(spark, "late")
    for i, minute in enumerate([0, 30, 31, 5]):
        write(spark, folder, f"{i}", [(at(minute), "t")], READING)
    write(spark, folder, "9", [(at(59, 23), "t")], READING)
    schema = spark.createDataFrame([], READING).schema
    stream = streams.file_stream(spark, f"{folder}/*", schema, files_per_trigger=1)
    counts = windows.sliding_counts(stream, ["tenant_id"], window="5 minutes", slide="5 minutes")
    kept = {(r.window_start, r.event_count) for r in runs.append_now(counts, "late-out").collect()}
    assert kept == {(at(0), 1), (at(30), 2)}


def test_replayed_file_does_not_change_the_lake(spark):
    folder, target = scratch(spark, "replay"), fresh_lake(spark)
    data = [message("s-1", 0), message("s-1", 1), message("s-2", 2)]
    for name in ("a", "b"):
        write(spark, folder, name, data, schemas.MESSAGE)
    stream = streams.message_stream(spark, "files", path=f"{folder}/*", files_per_trigger=1)
    ingest.ingest(stream, target, scratch(spark, "replay-state"), None).awaitTermination()
    assert spark.table(target.readings).count() == 3


def test_no_message_is_lost_however_late(spark):
    """Three files, one a batch, the oldest last: stored and dead together are all of them."""
    folder, target = scratch(spark, "late-ingest"), fresh_lake(spark)
    n = 0
    for nth, day in enumerate([20, 10, 1]):
        rows = [(topic, value, partition, 1000 * nth + offset, when + datetime.timedelta(days=day))
                for topic, value, partition, offset, when in [message(f"s-{i % 3}", i) for i in range(40)]]
        rows += [("iot.x", bytearray(b"{}"), 0, 1000 * nth + 900, rows[0][4])]
        n += len(rows)
        write(spark, folder, f"{nth}", rows, schemas.MESSAGE)
    stream = streams.message_stream(spark, "files", path=f"{folder}/*", files_per_trigger=1)
    ingest.ingest(stream, target, scratch(spark, "late-ingest-state"), None).awaitTermination()
    assert (spark.table(target.readings).count(), spark.table(target.dead_letters).count()) == (n - 3, 3)


def test_late_row_is_dropped_from_closed_panes(spark):
    folder = scratch(spark, "late-panes")
    for i, minute in enumerate([0, 30, 31, 5]):
        write(spark, folder, f"{i}", [(at(minute), "t")], READING)
    write(spark, folder, "9", [(at(59, 23), "t")], READING)
    schema = spark.createDataFrame([], READING).schema
    stream = streams.file_stream(spark, f"{folder}/*", schema, files_per_trigger=1)
    counts = windows.closed_sliding_counts(stream, ["tenant_id"], window="5 minutes", slide="5 minutes")
    kept = {(r.window_start, r.event_count) for r in runs.append_now(counts, "late-out").collect()}
    assert kept == {(at(0), 1), (at(30), 2)}


def test_repeated_batch_replaces_its_rows_and_new_files_are_added(spark):
    folder, target, state = scratch(spark, "again"), fresh_lake(spark), scratch(spark, "again-state")
    write(spark, folder, "a", [message("s-1", 0), message("s-1", 1)], schemas.MESSAGE)
    source = lambda: streams.message_stream(spark, "files", path=f"{folder}/*")
    ingest.ingest(source(), target, state, None).awaitTermination()
    write(spark, folder, "b", [message("s-1", 2, 1), ("iot.x", bytearray(b"{}"), 0, 3, at(1))], schemas.MESSAGE)
    ingest.ingest(source(), target, state, None).awaitTermination()
    assert spark.table(target.readings).count() == 3
    assert spark.table(target.dead_letters).count() == 1
    batch = spark.read.schema(schemas.MESSAGE).parquet(f"{folder}/a")
    for _ in range(2):
        ingest.write_batch(target)(batch, 77)
    assert spark.table(target.readings).count() == 5


def test_commit_that_failed_half_way_is_completed(spark):
    """Only the rows the first try did not store are added by the second."""
    target = fresh_lake(spark)
    batch = spark.createDataFrame([message("s-1", i) for i in range(10)], schemas.MESSAGE)
    rows = readings.parsed(batch)
    target.append(readings.accepted(rows).filter("_offset < 4"), "c-1")
    for _ in range(2):
        target.append(readings.accepted(rows), "c-1", repeated=True)
    assert spark.table(target.readings).count() == 10
    assert spark.table(target.readings).select("_offset").distinct().count() == 10


def test_batches_in_a_row_are_not_checked_again(spark):
    target = fresh_lake(spark)
    write_one = ingest.write_batch(target)
    write_one(spark.createDataFrame([message("s-1", 0)], schemas.MESSAGE), 0)
    checked = []
    plain = target._commit
    target._commit = lambda rows, table, commit, repeated, *rest: (
        checked.append(repeated), plain(rows, table, commit, repeated, *rest))
    write_one(spark.createDataFrame([message("s-1", 1)], schemas.MESSAGE), 1)
    write_one(spark.createDataFrame([message("s-1", 1)], schemas.MESSAGE), 1)
    assert checked == [False, False, True, True]
    assert spark.table(target.readings).count() == 2


def test_batch_that_comes_again_is_parsed_only_if_a_row_is_missing(spark, monkeypatch):
    """A stored row that went missing comes back; a dead letter and a reading of an early day count as stored."""
    target, seen = fresh_lake(spark), []
    plain = ingest.parsed
    monkeypatch.setattr(ingest, "parsed", lambda batch: (seen.append(batch.count()), plain(batch))[1])
    write_one = ingest.write_batch(target)
    rows = [message("s-1", 0), message("s-1", 1, 1), ("iot.x", bytearray(b"{}"), 0, 3, at(1))]
    batch = lambda some: spark.createDataFrame(some, schemas.MESSAGE)
    for some in (rows, rows * 2, [*rows, message("s-1", 9)], [("iot.y", None, None, None, None)], [("iot.y", None, None, None, None)]):
        write_one(batch(some), 5)
    assert seen == [3, 0, 4, 1, 1]
    assert spark.table(target.readings).count() == 3
    write_one(batch([message("s-1", 20)]), 6)
    write_one(batch(rows), 5)
    assert seen == [3, 0, 4, 1, 1, 1, 3]
    assert spark.table(target.readings).count() == 4


def test_empty_batch_writes_nothing(spark):
    target = fresh_lake(spark)
    ingest.write_batch(target)(spark.createDataFrame([], schemas.MESSAGE), 0)
    assert spark.sql(f"SHOW PARTITIONS {target.readings}").count() == 0


def test_one_busy_sensor_is_spread_over_files(spark, monkeypatch):
    monkeypatch.setattr(lake, "ROWS_PER_FILE", 100)
    target = fresh_lake(spark)
    # So few bytes would otherwise be joined into one task again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ingest.write_batch(target)(
            spark.createDataFrame([message("s-1", i) for i in range(900)], schemas.MESSAGE), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = spark.table(target.readings)
    sizes = [r[0] for r in table.groupBy(F.input_file_name()).count().select("count").collect()]
    assert table.count() == 900 and len(sizes) >= 5 and max(sizes) < 400


def test_stream_counters_equal_batch(tables, rows):
    stream = counters.message_counters(tables.streamed("readings"), ["sensor_id"])
    got = runs.update_now(stream, ["sensor_id"], "test-counters")
    want = tables.readings.groupBy("sensor_id").agg(
        F.sum("increment").alias("message_count"), F.max("event_time").alias("last_message_at"))
    assert rows(got, *want.columns) == rows(want)


def test_unrouted_messages_are_dropped(spark, rows):
    routes = spark.createDataFrame([("a/1", "a.1")], "path string, target string")
    messages = spark.createDataFrame([("a/1", "x"), ("b/2", "y")], "path string, value string")
    assert rows(counters.route(messages, routes)) == [("a.1", "a/1", "x")]


@pytest.mark.parametrize("files_per_trigger", [1, 64])
def test_billing_does_not_depend_on_batches_or_order(spark, tables, rows, files_per_trigger):
    """The later half first, a part of it twice, one file or all files a batch."""
    events = tables.account_events
    folder = scratch(spark, "fold")
    late = F.col("happened_at") >= F.lit("1998-01-01").cast("timestamp")
    for name, part in enumerate((events.filter(late), events.filter(~late), events.filter(late & (F.col("id") < 3000)))):
        part.coalesce(1).write.parquet(f"{folder}/in/{name}")
        time.sleep(0.05)
    stream = streams.file_stream(spark, f"{folder}/in/*", events.schema, files_per_trigger=files_per_trigger)
    billing_log.record_events(stream, f"{folder}/events", f"{folder}/state", None).awaitTermination()
    got = rows(billing_log.billing_states(spark, f"{folder}/events"))
    assert got and got == rows(account_history.account_states(events))


def test_first_message_activates_once(spark, rows):
    sensors = spark.createDataFrame([("s-1", "t", "pending"), ("s-2", "t", "active"), ("s-3", "t", "pending")],
                                    "sensor_id string, tenant_id string, status string")
    data = [("s-1", at(5), 2, 7), ("s-1", at(1), 1, 3), ("s-1", at(1), 9, 4), ("s-2", at(0), 3, 1)]
    arrived = spark.createDataFrame(data, "sensor_id string, event_time timestamp, event_id long, increment long")
    assert rows(readings.activations(arrived, sensors), "sensor_id", "status", "event_type", "messages") == [
        ("s-1", "active", "data_received", 3)]


def test_unknown_source_kind(spark):
    with pytest.raises(ValueError):
        streams.message_stream(spark, "carrier pigeon")


def test_a_sensor_crosses_its_budget_once(spark, tmp_path):
    """The first crossing in order of events, over several batches and a restart; equal to the one of the whole history."""
    schema = "sensor_id string, event_id long, event_time timestamp, increment int"
    sensors = spark.createDataFrame([("a", "active", schemas.PRICES.message * 5), ("b", "active", schemas.PRICES.message * 900), ("c", "inactive", schemas.PRICES.message), ("d", "active", 0.0),
                                     ("e", "active", schemas.PRICES.message * 7)], "sensor_id string, status string, budget double")
    began = datetime.datetime(2026, 1, 1)
    data = [(s, i, began + datetime.timedelta(seconds=i // 2), 1 + i % 2) for i in range(60) for s in ("a", "b", "c", "d", "e") if s != "e" or i < 50]
    result = None
    for part in range(3):  # the second and third start go on from the state of the first
        own = data[part * len(data) // 3:(part + 1) * len(data) // 3]
        spark.createDataFrame(own[::-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = counters.first_crossings(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), sensors)
        writer = found.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
        runs.start(writer, str(tmp_path / "state"), None).awaitTermination()
        result = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    columns = ["sensor_id", "event_id", "event_time", "messages", "cost", "budget", "status"]
    want = billing.deactivate_over_budget(spark.createDataFrame(data, schema), sensors).select(*columns)
    assert sorted(map(tuple, result.select(*columns).collect())) == sorted(map(tuple, want.collect()))
    assert [r.sensor_id for r in result.orderBy("sensor_id").collect()] == ["a", "e"]


def test_parts_are_handed_over_in_files_of_bounded_rows(spark, tables, monkeypatch):
    """A file is read and parsed by one task, however many rows it has."""
    monkeypatch.setattr(streaming_queries, "FILE_ROWS", 40)
    files = []

    def run(part):
        def look(batch, _):
            files.extend(r["count"] for r in batch.groupBy(F.input_file_name().alias("file")).count().collect())
        runs.start(part.writeStream.foreachBatch(look), state, None).awaitTermination()
    state = scratch(spark, "bounded-files-state")
    streaming_queries.newest_first(tables, "bounded-files", run)
    assert sum(files) == tables.messages.count() and max(files) <= 40
