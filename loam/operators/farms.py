"""Farm and crop reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import records


def crops_with_farm(crops: DataFrame, farms: DataFrame) -> DataFrame:
    return crops.join(farms.select("farm_id", "farm_name"), "farm_id", "left")


def harvest_schedule(crops: DataFrame, now: str) -> DataFrame:
    days = records.days_until(F.col("expected_harvest_date"), F.lit(now).cast("timestamp"))
    return (crops.withColumn("days_to_harvest", days)
            .withColumn("label", records.harvest_label(F.col("days_to_harvest"))))


def harvest_countdown(farm_crops: DataFrame) -> DataFrame:
    """Typical growing time of each crop with its urgency and share of a year."""
    return (farm_crops.withColumn("growing_days", records.growing_days(F.col("crop")))
            .withColumn("urgency", records.harvest_urgency(F.col("growing_days")))
            .withColumn("season_pct", records.season_percent(F.col("growing_days"))))


def farm_crops(farms: DataFrame) -> DataFrame:
    return farms.select("farm_id", "tenant_id", "farm_name", F.explode("crops").alias("crop"))


def crop_varieties(farms: DataFrame, keys: list[str]) -> DataFrame:
    return farm_crops(farms).groupBy(*keys).agg(
        F.count_distinct(F.lower("crop")).alias("varieties"))


def crop_chips(farms: DataFrame) -> DataFrame:
    return farms.select("farm_id", records.first_crops(F.col("crops")).alias("shown"),
                        records.hidden_crops(F.col("crops")).alias("hidden"))


def new_crop_records(farms: DataFrame, recorded: DataFrame) -> DataFrame:
    """Crops a farm lists that have no record yet."""
    listed = farm_crops(farms).select("farm_id", F.col("crop").alias("crop_name"))
    known = recorded.select("farm_id", "crop_name")
    return listed.distinct().join(known, ["farm_id", "crop_name"], "left_anti")
