"""Options of connectors whose drivers are not on the class path, by a recording reader."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from loam.sources import avro, streams, tables


class Recorder:
    """Stands in for a reader or writer and notes what it is told."""

    def __init__(self):
        self.told, self.kind, self.columns = {}, None, None

    def __getattr__(self, name):
        if name in ("read", "readStream", "writeStream"):
            return self
        raise AttributeError(name)

    def format(self, kind):
        self.kind = kind
        return self

    def option(self, key, value):
        self.told[key] = value
        return self

    def options(self, **named):
        self.told |= named
        return self

    def load(self):
        return self

    def start(self):
        return self

    def select(self, *columns):
        self.columns = columns
        return self


def test_stream_of_topics_by_pattern():
    seen = streams.kafka_stream(Recorder(), "broker:1")
    assert seen.kind == "kafka" and list(seen.columns) == streams.MESSAGE_COLUMNS
    assert seen.told == {"kafka.bootstrap.servers": "broker:1", "subscribePattern": streams.SENSOR_TOPICS, "startingOffsets": "earliest",
                         "failOnDataLoss": "true", "kafka.metadata.max.age.ms": "30000"}


def test_stream_of_one_topic_with_limits():
    seen = streams.kafka_stream(Recorder(), "broker:1", topic="raw", starting="latest", per_trigger=10000, fail_on_data_loss=False, **{"minPartitions": "8"})
    assert seen.told["subscribe"] == "raw" and "subscribePattern" not in seen.told
    assert (seen.told["startingOffsets"], seen.told["maxOffsetsPerTrigger"], seen.told["failOnDataLoss"], seen.told["minPartitions"]) == (
        "latest", "10000", "false", "8")


def test_table_of_a_range_of_offsets():
    start = streams.tail_offsets({"iot.1.a": {0: 25, 1: 4}})
    assert json.loads(start) == {"iot.1.a": {"0": 15, "1": 0}}
    seen = streams.kafka_table(Recorder(), "broker:1", starting=start)
    assert (seen.told["startingOffsets"], seen.told["endingOffsets"], seen.told["subscribePattern"]) == (start, "latest", streams.SENSOR_TOPICS)


def test_the_source_is_chosen_by_name(spark):
    assert streams.message_stream(Recorder(), "kafka", servers="b", topic="t").told["subscribe"] == "t"
    with pytest.raises(ValueError):
        streams.message_stream(spark, "mail")


def test_published_rows():
    seen = streams.publish(Recorder(), "broker:1", "/state", acks="all")
    assert seen.kind == "kafka"
    assert seen.told == {"kafka.bootstrap.servers": "broker:1", "checkpointLocation": "/state", "acks": "all"}


def test_dimension_is_read_in_key_ranges():
    seen = tables.dimension(Recorder(), "jdbc:x", "sensors", "id", 1, 900, 4, user="u")
    assert seen.kind == "jdbc"
    assert seen.told == {"url": "jdbc:x", "dbtable": "sensors", "user": "u", "partitionColumn": "id", "lowerBound": 1, "upperBound": 900, "numPartitions": 4}


def test_times_in_milliseconds_become_timestamps(spark):
    declared = json.dumps({"type": "record", "name": "r", "fields": [
        {"name": "at", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "v", "type": ["null", "double"]}]})
    frame = spark.createDataFrame([('{"at": 1704067200123, "v": 2.5}',), ("broken",)], "j string")
    got = frame.select(avro.decode(F.col("j"), declared).alias("r")).select(F.col("r.at").cast("string"), "r.v").collect()
    assert [tuple(r) for r in got] == [("2024-01-01 00:00:00.123", 2.5), (None, None)]


def test_times_in_milliseconds_are_found_at_any_depth(spark):
    time = {"type": "long", "logicalType": "timestamp-millis"}
    inner = {"type": "record", "name": "i", "fields": [{"name": "at", "type": ["null", time]}, {"name": "n", "type": "int"}]}
    declared = json.dumps({"type": "record", "name": "r", "fields": [
        {"name": "one", "type": ["null", inner]}, {"name": "many", "type": {"type": "array", "items": inner}},
        {"name": "times", "type": {"type": "array", "items": time}}, {"name": "named", "type": {"type": "map", "values": ["null", inner]}}]})
    data = [{"one": {"at": 1704067200123, "n": 1}, "many": [{"at": 0, "n": 2}, {"at": None, "n": 3}], "times": [1, 1704067200000],
             "named": {"a": {"at": 1000, "n": 4}, "b": None}}, {"one": None, "many": [], "times": [], "named": {}}]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(data)], "i int, j string")
    full, empty = frame.select("i", avro.decode(F.col("j"), declared).alias("r")).orderBy("i").select("r.*").collect()
    when = lambda ms: datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)
    assert tuple(full.one) == (when(1704067200123), 1)
    assert [tuple(r) for r in full.many] == [(when(0), 2), (None, 3)]
    assert full.times == [when(1), when(1704067200000)]
    assert tuple(full.named["a"]) == (when(1000), 4) and full.named["b"] is None
    assert empty.one is None and empty.many == [] and empty.named == {}
