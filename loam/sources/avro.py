"""Registry schemas (Avro record declarations) as Spark schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PRIMITIVES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "bytes": T.BinaryType(), "null": T.NullType(),
}


def spark_type(declared) -> tuple[T.DataType, bool]:
    """Spark type of an Avro declaration and whether it may be null."""
    if isinstance(declared, list):
        members = [m for m in declared if m != "null"]
        if len(members) != 1:
            raise ValueError("only nullable unions are supported")
        return spark_type(members[0])[0], True
    if isinstance(declared, str):
        return _PRIMITIVES[declared], False
    kind = declared["type"]
    if declared.get("logicalType") == "timestamp-millis":
        return T.TimestampType(), False
    if kind == "record":
        return record_schema(declared), False
    if kind == "map":
        value, optional = spark_type(declared["values"])
        return T.MapType(T.StringType(), value, optional), False
    if kind == "array":
        item, optional = spark_type(declared["items"])
        return T.ArrayType(item, optional), False
    if kind == "enum":
        return T.StringType(), False
    return spark_type(kind)


def record_schema(declared) -> T.StructType:
    record = json.loads(declared) if isinstance(declared, str) else declared
    return T.StructType([T.StructField(f["name"], *spark_type(f["type"]))
                         for f in record["fields"]])


def decode(value: Column, declared: str) -> Column:
    """JSON text of a registry record as a struct; malformed text gives null fields.

    Times in milliseconds become timestamps wherever they stand: in records, arrays and maps.
    """
    schema = record_schema(declared)
    read = F.from_json(value.cast("string"), _with_millis(schema))
    return F.struct(*[_timed(read[f.name], f.dataType).alias(f.name) for f in schema.fields]) if _has_time(schema) else read


def _has_time(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_time(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_time(kind.elementType)
    return _has_time(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.TimestampType)


def _with_millis(kind: T.DataType) -> T.DataType:
    """The type as it is written: times are whole numbers."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _with_millis(f.dataType), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_with_millis(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _with_millis(kind.valueType), kind.valueContainsNull)
    return T.LongType() if isinstance(kind, T.TimestampType) else kind


def _timed(column: Column, kind: T.DataType) -> Column:
    """A value as it was written, with its times as timestamps; a null record stays null."""
    if not _has_time(kind):
        return column
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[_timed(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda item: _timed(item, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, item: _timed(item, kind.valueType))
    return F.timestamp_millis(column)


def decode_binary(value: Column, declared: str) -> Column:
    """Avro bytes of a registry record as a struct; needs Spark's Avro module on the class path."""
    from pyspark.sql.avro.functions import from_avro
    return from_avro(value, declared, {"mode": "PERMISSIVE"})


def is_backward_compatible(old: str, new: str) -> bool:
    """A reader with `new` can read rows of `old`: every added field is optional or defaulted."""
    before = {f["name"]: f for f in json.loads(old)["fields"]}
    for field in json.loads(new)["fields"]:
        known = before.get(field["name"])
        if known is None:
            if "default" not in field:
                return False
        elif not _widens(spark_type(known["type"]), spark_type(field["type"])):
            return False
    return True


def _widens(old: tuple[T.DataType, bool], new: tuple[T.DataType, bool]) -> bool:
    if old[1] and not new[1]:
        return False
    ladder = [T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]
    if old[0] in ladder and new[0] in ladder:
        return ladder.index(old[0]) <= ladder.index(new[0])
    return old[0] == new[0]
