"""Positions of rows inside their key, from counts per range of a total order.

A row number over a window puts every row of a key into one task, whatever its order.
Here all rows are range-partitioned by key and order together (Spark samples the range
borders), so a part is bounded by rows: a hot key, a burst of times or texts with one
beginning only make a key span more parts. The sorted parts are written once; a row's
position is its place in its part plus what the parts before hold of its key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.records import page_count
from loam.session import scratch

PART, PLACE = "_part", "_place"
PLACE_BITS = 33
"""Fixed value: monotonically_increasing_id has the part above these bits."""


@dataclass(frozen=True)
class RankIndex:
    """`rows` are the sorted rows with part and place, `ranges` a row for each part and key:
    the first place, the number of rows, and the rows of the key in earlier parts.

    Columns named `_part` and `_place` are the index's own. Null keys are a key, and null
    order values come where the order puts them. Rows that tie in the whole order are
    numbered in no particular order, so it should end in a unique column.
    """
    rows: DataFrame
    ranges: DataFrame
    keys: list[str]

    @classmethod
    def build(cls, frame: DataFrame, keys: list[str], order: list[str | Column], folder: str | None = None) -> RankIndex:
        """Sorts and writes the rows; `folder` keeps the index for later sessions."""
        if {PART, PLACE} & set(frame.columns):
            raise ValueError(f"{PART} and {PLACE} are taken by the index")
        spark, folder = frame.sparkSession, folder or scratch(frame.sparkSession, "ranks")
        nth = F.monotonically_increasing_id()
        (frame.orderBy(*keys, *order).withColumn(PLACE, nth)
         .withColumn(PART, F.shiftright(PLACE, PLACE_BITS))
         .withColumn(PLACE, F.col(PLACE).bitwiseAND((1 << PLACE_BITS) - 1))
         .write.partitionBy(PART).parquet(f"{folder}/rows"))
        earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        counted = cls._read(spark, folder, frame).groupBy(*keys, PART).agg(
            F.min(PLACE).alias("first"), F.count(F.lit(1)).alias("n"))
        (counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
         .write.parquet(f"{folder}/ranges"))
        return cls(cls._read(spark, folder, frame), spark.read.parquet(f"{folder}/ranges"), keys)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, keys: list[str]) -> RankIndex:
        """An index that `build` has written."""
        ranges = spark.read.parquet(f"{folder}/ranges")
        like = spark.read.parquet(f"{folder}/rows").drop(PART, PLACE)
        return cls(cls._read(spark, folder, like), ranges, keys)

    @staticmethod
    def _read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
        schema = T.StructType([*like.schema.fields, T.StructField(PLACE, T.LongType()), T.StructField(PART, T.LongType())])
        return spark.read.schema(schema).parquet(f"{folder}/rows")

    def numbered(self, name: str = "position") -> DataFrame:
        """The rows with their position inside the key, from 1."""
        rows, ranges = self.rows.alias("r"), self.ranges.alias("g")
        same = F.col(f"r.{PART}") == F.col(f"g.{PART}")
        for key in self.keys:
            same &= F.col(f"r.{key}").eqNullSafe(F.col(f"g.{key}"))
        kept = [F.col(f"r.{c}") for c in self.rows.columns if c not in (PART, PLACE)]
        return rows.join(ranges, same).select(*kept, _position("r", "g").alias(name))

    def page(self, number: int, per_page: int, **key) -> DataFrame:
        """Page `number` of one key in order, with the key's total and page count.

        Only the parts that hold the page are read. They are found in the ranges, of which
        a page meets at most one for each of its rows.
        """
        if set(key) != set(self.keys):
            raise ValueError(f"a page is of one key: {self.keys}")
        own = self.ranges
        for name, value in key.items():
            own = own.where(F.col(name).eqNullSafe(F.lit(value)))
        low = (number - 1) * per_page
        met = own.where((F.col("before") < low + per_page) & (F.col("before") + F.col("n") > low))
        found = {r[PART]: r["before"] - r["first"] for r in met.select(PART, "before", "first").collect()}
        total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
        rows = self.rows.where(F.col(PART).isin(*found))
        for name, value in key.items():
            rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
        shift = F.lit(0)
        for part, by in found.items():
            shift = F.when(F.col(PART) == part, F.lit(by)).otherwise(shift)
        at = F.col(PLACE) + shift
        return (rows.where((at >= low) & (at < low + per_page)).orderBy(PART, PLACE).drop(PART, PLACE)
                .withColumn("total", total).withColumn("pages", page_count(F.col("total"), per_page)))


def _position(rows: str, ranges: str) -> Column:
    return F.col(f"{ranges}.before") + F.col(f"{rows}.{PLACE}") - F.col(f"{ranges}.first") + 1
