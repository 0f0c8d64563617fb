"""Column expressions that read a sensor message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam import schemas

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso_timestamp(text: Column) -> Column:
    """Strict second-precision UTC timestamp; anything else is null."""
    return F.try_to_timestamp(text, F.lit(ISO_SECONDS))


def utc_timestamp(text: Column) -> Column:
    """Lenient ISO timestamp; text without a zone suffix is taken as UTC."""
    has_zone = F.substring(text, 11, 64).rlike("[Z+]")
    return F.try_to_timestamp(F.when(has_zone, text).otherwise(F.concat(text, F.lit("Z"))))


def calendar_parts(ts: Column) -> dict[str, Column]:
    return {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts)}


def topic_part(topic: Column, index: int) -> Column:
    return F.get(F.split(topic, r"\."), F.lit(index))


def topic_is_valid(topic: Column) -> Column:
    """Exactly namespace.tenant.sensor."""
    return F.size(F.split(topic, r"\.")) == 3


def payload(json: Column) -> Column:
    """Envelope, location and measurement blocks in one pass over the text."""
    return F.from_json(json, schemas.PAYLOAD, {"columnNameOfCorruptRecord": schemas.CORRUPT})


def payload_is_valid(parsed: Column) -> Column:
    return parsed.isNotNull() & parsed[schemas.CORRUPT].isNull()


def canonical_type(raw: Column) -> Column:
    pairs = [F.lit(x) for pair in schemas.TYPE_ALIASES.items() for x in pair]
    known = F.try_element_at(F.create_map(*pairs), F.lower(raw))
    return F.coalesce(known, F.lit(schemas.UNKNOWN_TYPE))


def metric_block(parsed: Column, sensor_type: Column) -> Column:
    """The measurement block of the row's own type as JSON text, null for unknown types."""
    block = F.lit(None).cast("string")
    for name, field in schemas.METRIC_BLOCKS.items():
        block = F.when(sensor_type == name, parsed[field]).otherwise(block)
    return block


def topic_of_path(path: Column) -> Column:
    """`a/b/c/data` as the stream topic `a.b.c`."""
    return F.regexp_replace(F.regexp_replace(path, "/data$", ""), "/", ".")


def path_of_topic(topic: Column) -> Column:
    return F.concat(F.replace(topic, F.lit("."), F.lit("/")), F.lit("/data"))


def encode_path(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("__"))


def decode_path(path: Column) -> Column:
    return F.replace(path, F.lit("__"), F.lit("/"))


def age_label(ts: Column, now: Column) -> Column:
    """Relative age such as `5m ago`."""
    seconds = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 1_000_000)
    def label(unit: int, suffix: str) -> Column:
        return F.concat(F.floor(seconds / unit).cast("string"), F.lit(suffix))
    return (F.when(seconds < 5, F.lit("just now"))
            .when(seconds < 60, label(1, "s ago"))
            .when(seconds < 3600, label(60, "m ago"))
            .when(seconds < 86400, label(3600, "h ago"))
            .otherwise(label(86400, "d ago")))
