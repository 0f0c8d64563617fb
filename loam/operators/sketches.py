"""Distinct counts and quantiles from sketches kept per day.

A day's rows are read once; every later question over any range of days and any coarser
keys merges the stored sketches, some kilobytes a day and key, and reads no row again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "day"
DISTINCT_LG_K = 12
"""Registers of a distinct sketch, as a power of two: a relative error of about 1.6% (one deviation)."""
QUANTILE_K = 400
"""Size of a quantile sketch: a rank error of about 0.7%, also after merging."""


class DailySketches:
    """A table of sketches by day and keys: `n`, `distinct_<column>` and `quantiles_<column>`.

    Distinct columns are texts, bytes or whole numbers; measured ones become doubles, their
    nulls and NaN values count in `n` only. Rows without a time are kept under the null day.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], distinct: list[str], measured: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.distinct, self.measured = distinct, measured

    def refresh(self, rows: DataFrame, time: str) -> None:
        """Replaces the days that occur in `rows` by sketches of these rows; other days stay.

        Repeating a refresh changes nothing, so a lost writer is simply started again.
        """
        values = {c: F.col(c).cast("double") for c in self.measured}
        daily = rows.groupBy(F.to_date(time).alias(DAY), *self.keys).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.hll_sketch_agg(c, DISTINCT_LG_K).alias(f"distinct_{c}") for c in self.distinct],
            *[F.kll_sketch_agg_double(F.when(~F.isnan(v), v), QUANTILE_K).alias(f"quantiles_{c}") for c, v in values.items()])
        (daily.repartition(DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(DAY).parquet(self.folder))

    def days(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """Stored sketches of a range of days, both included; other days' files are not read."""
        stored = self.spark.read.parquet(self.folder).withColumn(DAY, F.col(DAY).cast("date"))
        if first:
            stored = stored.where(F.col(DAY) >= F.lit(first).cast("date"))
        return stored.where(F.col(DAY) <= F.lit(last).cast("date")) if last else stored

    def merged(self, by: list[str | Column], first: str | None = None, last: str | None = None) -> DataFrame:
        """Sketches merged to coarser keys, in no particular order."""
        return self.days(first, last).groupBy(*by).agg(
            F.sum("n").alias("n"), *[F.hll_union_agg(f"distinct_{c}").alias(f"distinct_{c}") for c in self.distinct],
            *[F.kll_merge_agg_double(f"quantiles_{c}").alias(f"quantiles_{c}") for c in self.measured])

    def estimates(self, by: list[str | Column], ranks: list[float], first: str | None = None, last: str | None = None) -> DataFrame:
        """Per key: n (exact), `<column>_distinct`, and an array `<column>_at` of the values at the ranks.

        A column without any value has 0 distinct ones and null quantiles.
        """
        merged = self.merged(by, first, last)
        keys = [c for c in merged.columns if c != "n" and not c.startswith(("distinct_", "quantiles_"))]

        def at(column: str) -> Column:
            sketch = F.col(f"quantiles_{column}")
            return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.array(*[F.kll_sketch_get_quantile_double(sketch, F.lit(r)) for r in ranks]))
        return merged.select(*keys, "n", *[F.hll_sketch_estimate(f"distinct_{c}").alias(f"{c}_distinct") for c in self.distinct],
                             *[at(c).alias(f"{c}_at") for c in self.measured])
