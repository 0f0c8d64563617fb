"""Pages, newest-per-key selections and bounded list columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.records import page_count
from loam.plans.ranks import RankIndex


def page(frame: DataFrame, newest: str, tie: str, number: int, per_page: int) -> DataFrame:
    """One page, newest first, with the total and page count beside every row.

    For pages near the front; those far down are read from a `RankIndex`.
    """
    total = frame.agg(F.count(F.lit(1))).scalar()
    ordered = frame.orderBy(F.col(newest).desc(), F.col(tie).desc())
    rows = ordered.offset((number - 1) * per_page).limit(per_page)
    return rows.withColumn("total", total).withColumn("pages", page_count(F.col("total"), per_page))


def newest(frame: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each key. The rank limit is applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def paged_lists(frame: DataFrame, keys: list[str], order: list[str], item: Column,
                page_size: int = 1000) -> DataFrame:
    """Items of each key as ordered lists of at most `page_size`, numbered from 1.

    Rows are numbered by ranges of the order, so neither a tenant with a third of all rows
    nor texts that begin alike end up in one task.
    """
    numbered = RankIndex.build(frame, keys, order).numbered("_at")
    paged = numbered.withColumn("page", (F.floor((F.col("_at") - 1) / page_size) + 1).cast("long"))
    entry = F.struct(F.col("_at"), item.alias("item"))
    return (paged.groupBy(*keys, "page")
            .agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
            .select(*keys, "page", F.transform("_entries", lambda e: e["item"]).alias("items")))
