"""The catalog as a tree: schemas, tables and their columns in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYSTEM_SCHEMAS = ["information_schema"]
_COLUMNS = "schema_name string, table_name string, position int, column_name string, data_type string"


def columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """One row per column of every table and view; metadata only."""
    rows = []
    for table in spark.catalog.listTables(database) if database else spark.catalog.listTables():
        schema = ".".join(table.namespace or []) or "session"
        full = table.name if table.isTemporary else f"{schema}.{table.name}"
        for at, field in enumerate(spark.table(full).schema.fields, start=1):
            rows.append((schema, table.name, at, field.name, field.dataType.simpleString()))
    found = spark.createDataFrame(rows, _COLUMNS)
    return found.filter(~F.col("schema_name").isin(*SYSTEM_SCHEMAS))


def tree(spark: SparkSession, database: str | None = None, search: str = "") -> DataFrame:
    """Tables with their columns in order; a search text keeps tables whose name contains it."""
    listed = columns(spark, database)
    if search:
        listed = listed.filter(F.lower("table_name").contains(search.lower()))
    entry = F.struct("position", F.col("column_name").alias("name"),
                     F.col("data_type").alias("type"))
    return (listed.groupBy("schema_name", "table_name")
            .agg(F.sort_array(F.collect_list(entry)).alias("columns"))
            .orderBy("schema_name", "table_name"))
