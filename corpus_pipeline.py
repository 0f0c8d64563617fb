"""From raw documents to packed sequences: the corpus operators in a row."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import language_id, quality_model
from loam.llm.jaccard_join import jaccard_join
from loam.llm.mixing import mixed
from loam.llm.packing import pack
from loam.llm.shared import importable, stored, table


def _same_columns(judged: DataFrame, docs: DataFrame) -> DataFrame:
    return judged.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the nearest centroid does not tell: texts that are
    null, without letters, or too far from every centroid for their size."""
    importable(spark)
    learnt = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(True))
    model = language_id.fit(docs, learnt)
    judged = language_id.identify(docs, model, *[F.col(c) for c in docs.columns], text=docs.columns.index("text"))
    return _same_columns(judged.where("not rejected"), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the factorisation machine predicts to be of label 0."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    judged = quality_model.score(docs, model, *[F.col(c) for c in docs.columns], text=docs.columns.index("text"))
    return _same_columns(judged.where("predicted = 1"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that five-word shingles link at a similarity of 0.8.

    Rows are told apart by a number of their own: different texts that share an id are
    judged apart, and unrelated groups stay apart. Of a group the row with the smallest id
    stays, of equal ids that with the smallest hash of its text; null ids come last. Rows
    without words are in no group and stay.
    """
    importable(spark)
    row = "_row" + "_" * max((len(c) for c in docs.columns), default=0)
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = jaccard_join(rows, id_col=row, k=5, num=80, den=100).select(F.col(row).alias("_of"), "component_id")
    marks = rows.select(row, "doc_id", F.xxhash64("text").alias("_hash")).join(groups, F.col(row) == F.col("_of"))
    first = marks.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", F.col(row).alias("row"))).alias("first"))
    return rows.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the sources by weight; rows taken more than once are repeated."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 1,024."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("quality", quality), ("near copies", near_copies), ("mixture", mixture), ("packing", packing)]

ORACLE_SQL = None
"""The classifiers cannot be written in SQL; tests hold every stage against a plain version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each result written and read again."""
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
