"""Query statistics from Spark event logs, one row per SQL execution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = """
    Event string, executionId long, time long, description string,
    `Stage ID` int, `Stage IDs` array<int>,
    Properties struct<`spark.sql.execution.id`: string>,
    `Task Metrics` struct<`Executor CPU Time`: long, `Peak Execution Memory`: long,
                          `Input Metrics`: struct<`Bytes Read`: long>>
"""
_SQL = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecution"


def query_stats(spark: SparkSession, path: str) -> DataFrame:
    """Bytes read, CPU, peak task memory and wall time of each SQL execution."""
    log = spark.read.schema(_SCHEMA).json(path)
    event = F.col("Event")
    started = log.filter(event == _SQL + "Start").select(
        "executionId", F.col("time").alias("_start"), "description")
    ended = log.filter(event == _SQL + "End").select("executionId", F.col("time").alias("_end"))
    stages = (log.filter(event == "SparkListenerJobStart")
              .select(F.col("Properties")["spark.sql.execution.id"].cast("long")
                      .alias("executionId"), F.explode("Stage IDs").alias("_stage"))
              .filter("executionId IS NOT NULL").distinct())
    metrics = F.col("Task Metrics")
    tasks = log.filter(event == "SparkListenerTaskEnd").groupBy(
        F.col("Stage ID").alias("_stage")).agg(
        F.sum(metrics["Input Metrics"]["Bytes Read"]).alias("_bytes"),
        F.sum(metrics["Executor CPU Time"]).alias("_cpu_ns"),
        F.max(metrics["Peak Execution Memory"]).alias("_peak"))
    work = stages.join(tasks, "_stage").groupBy("executionId").agg(
        F.sum("_bytes").alias("processed_bytes"),
        (F.sum("_cpu_ns") / 1_000_000).cast("long").alias("cpu_ms"),
        F.max("_peak").alias("peak_mem_bytes"))
    return (started.join(ended, "executionId").join(work, "executionId", "left")
            .select(F.col("executionId").alias("query_id"), "description",
                    "processed_bytes", "cpu_ms", "peak_mem_bytes",
                    (F.col("_end") - F.col("_start")).alias("wall_ms"),
                    F.timestamp_millis("_start").alias("run_at")))
