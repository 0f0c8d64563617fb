"""Message parsing, topics and typed views on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from loam import schemas
from loam.functions import envelope as E
from loam.operators import readings
from loam.sources import avro

SOIL = {"device_id": "d-1", "timestamp": "2026-03-14T10:15:30Z", "tenant_id": "7", "farm_id": "f-1",
        "sensor_id": "s-1", "sensor_type": "soil_sensor",
        "location": {"latitude": 7.3775, "longitude": 3.947, "field_id": "A1"},
        "soil_metrics": {"moisture_percent": 31.5, "ph": 6.5}}
OTHER = {"device_id": "d-2", "timestamp": "2026-03-14T10:15:31.123Z", "sensor_type": "other",
         "pollution_metrics": {"pm10_ug_m3": 12.0}}


def messages(spark, records):
    data = [(topic, bytearray(value if isinstance(value, bytes) else json.dumps(value).encode()), 0, i, None)
            for i, (topic, value) in enumerate(records)]
    return spark.createDataFrame(data, schemas.MESSAGE)


def test_good_unknown_and_bad_rows(spark):
    parsed = readings.parsed(messages(spark, [
        ("iot.7.s-1", SOIL), ("iot.9.s-2", OTHER), ("iot.7.s-1", b"not json"), ("iot.7", SOIL),
        ("iot.a.b.c", SOIL), ("iot.7.s-1", b"[1, 2]"), ("iot.7.s-1", b"")]))
    good, unknown, *bad = parsed.orderBy("_offset").collect()
    assert (good.sensor_type, good.tenant_id, good.farm_id, good.sensor_id) == ("soil", "7", "f-1", "s-1")
    assert (good.year, good.month, good.day, good.hour) == (2026, 3, 14, 10)
    assert json.loads(good.metrics) == SOIL["soil_metrics"]
    assert json.loads(good.location) == SOIL["location"]
    assert (unknown.sensor_type, unknown.metrics, unknown.event_time) == ("unknown", None, None)
    assert (unknown.tenant_id, unknown.sensor_id, unknown.farm_id) == ("9", "s-2", None)
    assert [b.reject_reason for b in bad] == ["bad_json", "bad_topic", "bad_topic", "bad_json", "bad_json"]
    assert bad[0].device_id is None and bad[0].event_time is None
    assert readings.accepted(parsed).count() == 2
    assert readings.lake_rows(parsed).columns == [name for name, _ in schemas.LAKE_COLUMNS]


def test_dead_letters_keep_the_raw_text(spark, rows):
    parsed = readings.parsed(messages(spark, [("iot.7.s-1", b"not json"), ("iot.7.s-1", SOIL)]))
    assert rows(readings.dead_letters(parsed), "value", "reject_reason") == [("not json", "bad_json")]


@pytest.mark.parametrize("alias,kind", [("SOIL_Moisture", "soil"), ("lux_sensor", "light"), ("atmospheric", "pressure"),
                                        ("other", "unknown"), (None, "unknown"), ("", "unknown")])
def test_type_aliases(spark, alias, kind):
    frame = spark.createDataFrame([(alias,)], "raw string")
    assert frame.select(E.canonical_type(F.col("raw"))).first()[0] == kind


def test_every_canonical_type_has_a_block_and_fields():
    kinds = set(schemas.TYPE_ALIASES.values())
    assert kinds == set(schemas.METRIC_BLOCKS) == set(schemas.METRIC_FIELDS)
    assert len(schemas.TYPE_ALIASES) == 28 and len(schemas.GROWING_DAYS) == 27


def test_typed_pressure_keeps_the_trend_text(spark):
    value = {**SOIL, "sensor_type": "atmospheric", "pressure_data": {"atmospheric_hpa": 1000.5, "pressure_trend": "rising"}}
    parsed = readings.accepted(readings.parsed(messages(spark, [("iot.7.s-1", value)])))
    row = readings.typed_metrics(parsed, "pressure").first()
    assert (row.atmospheric_hpa, row.pressure_trend, row.temperature_c) == (1000.5, "rising", None)


def test_terminal_block_prefers_known_blocks(spark):
    both = {"air_quality": {"co2_ppm": 1}, "weather_data": {"uv_index": 2}}
    frame = readings.with_terminal_block(messages(spark, [("t", both), ("t", b'{"x":1}'), ("t", b"no")]))
    assert [r.metrics for r in frame.orderBy("offset").collect()] == ['{"co2_ppm":1}', '{"x":1}', "no"]


def test_nested_json_is_compact_and_keeps_scalars(spark):
    text = b'{"location": {"a": 1.50, "c":[1, 2]}, "soil_metrics":  "txt", "sensor_type": "soil"}'
    row = readings.parsed(messages(spark, [("iot.7.s-1", text)])).first()
    assert (row.location, row.metrics) == ('{"a":1.5,"c":[1,2]}', "txt")


@pytest.mark.parametrize("text,label", [
    ("2026-01-01T00:00:56Z", "just now"), ("2026-01-01T00:00:01", "59s ago"), ("2026-01-01T00:00:00Z", "1m ago"),
    ("2025-12-31T23:01:00+00:00", "1h ago"), ("2025-12-30T00:01:00", "2d ago")])
def test_age_label(spark, text, label):
    frame = spark.createDataFrame([(text,)], "t string")
    now = F.lit("2026-01-01 00:01:00").cast("timestamp")
    assert frame.select(E.age_label(E.utc_timestamp(F.col("t")), now)).first()[0] == label


def test_registry_schema_and_compatibility(spark):
    old = json.dumps({"type": "record", "name": "r", "fields": [{"name": "sensor_id", "type": "int"}]})
    optional = json.dumps({"type": "record", "name": "r", "fields": [
        {"name": "sensor_id", "type": "int"}, {"name": "location", "type": ["null", "string"], "default": None}]})
    required = json.dumps({"type": "record", "name": "r", "fields": [
        {"name": "sensor_id", "type": "long"}, {"name": "location", "type": "string"}]})
    assert avro.is_backward_compatible(old, optional)
    assert not avro.is_backward_compatible(old, required)
    assert not avro.is_backward_compatible(required, old)
    declared = json.dumps({"type": "record", "name": "r", "fields": [
        {"name": "sensor_id", "type": "int"}, {"name": "reading", "type": {"type": "map", "values": "double"}}]})
    frame = spark.createDataFrame([('{"sensor_id":3,"reading":{"t":1.5}}',), ("junk",)], "v string")
    good, bad = [r[0] for r in frame.select(avro.decode(F.col("v"), declared)).collect()]
    assert good.sensor_id == 3 and good.reading == {"t": 1.5}
    assert bad.sensor_id is None


def test_log_tail_takes_offsets_of_each_partition(spark, rows):
    data = [("a", bytearray(b"x"), p, o, None) for p, top in ((0, 25), (1, 4)) for o in range(top)]
    got = readings.log_tail(spark.createDataFrame(data, schemas.MESSAGE))
    assert rows(got, "partition", "offset") == sorted(
        [(0, o) for o in range(15, 25)] + [(1, o) for o in range(4)], key=repr)
