"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.session import scratch

WHITE = r"[ \t-\r]+"
"""Space and U+0009 to U+000D: what separates words."""


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared scratch folder and read again: cuts its lineage."""
    spark = frame.sparkSession
    folder = scratch(spark, purpose)
    schema = frame.schema
    frame.write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def in_few_files(frame: DataFrame, *key: str) -> DataFrame:
    """The frame dealt out anew by a key of its rows, so that what is stored has files by its size.

    A scan or join leaves a file for each of its tasks, however little they keep; adaptive
    execution merges and splits what is dealt out here.
    """
    return frame.hint("rebalance", *key)


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text that is not null."""
    return F.array_remove(F.split(text, WHITE), "")


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, component) of every node that has an edge (a, b); component: its smallest node.

    Alternating large and small stars: each round links every node to the smallest node
    it knows of, until the links are stars. Minima are pre-aggregated and joined back, so
    a hub with a third of all edges is only a skewed join, which adaptive execution splits.
    Each round is written to the shared folder. Self-links and nulls are ignored.
    """
    links = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), purpose)
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        small = large.join(least.withColumnRenamed("v", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.union(least).distinct(), purpose)
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
