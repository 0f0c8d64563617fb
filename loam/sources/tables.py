"""Batch tables: Parquet snapshots and relational dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dimension(spark: SparkSession, url: str, table: str, key: str, low: int, high: int,
              partitions: int = 16, **options: str) -> DataFrame:
    """A relational table read in key ranges, one connection per range."""
    return (spark.read.format("jdbc").options(url=url, dbtable=table, **options)
            .option("partitionColumn", key).option("lowerBound", low)
            .option("upperBound", high).option("numPartitions", partitions).load())
