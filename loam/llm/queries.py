"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import mixing, oracles
from loam.llm.embedding_dedup import near_duplicates
from loam.llm.hard_negatives import hard_negatives
from loam.llm.html_text import extract
from loam.llm.jaccard_join import jaccard_join
from loam.llm.language_id import language_id
from loam.llm.mixing import mix
from loam.llm.packing import pack
from loam.llm.periodic_runs import periodic_runs, repeated, run_digests
from loam.llm.quality_model import quality_scores
from loam.llm.quality_rules import quality_rules
from loam.llm.quote_links import link_quotes
from loam.llm.shared import table
from loam.llm.url_filters import PATTERNS, Rule, judge_urls, rule_table
from loam.llm.warc import archived
from loam.session import scratch


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id(table(spark, folder, "documents"))


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))


def op4_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archived(table(spark, folder, "pages"), scratch(spark, "warc"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


def op8_quote_links(spark: SparkSession, folder: str) -> DataFrame:
    return link_quotes(table(spark, folder, "conversations"))


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(table(spark, folder, "documents"), k=3, num=90, den=100)


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    hosts = [Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block")]
    return judge_urls(table(spark, folder, "pages"), rule_table(spark, hosts + PATTERNS))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return run_digests(periodic_runs(docs.select("doc_id", repeated(docs["doc_id"], docs["text"]).alias("text"))))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def all_sql() -> dict[str, str]:
    return {"op1_quality_rules": oracles.OP1, "op3_embedding_dedup": oracles.OP3, "op6_warc": oracles.OP6, "op7_mixing": mixing.ORACLE,
            "op8_quote_links": oracles.OP8, "op9_jaccard_join": oracles.OP9, "op11_url_filters": oracles.OP11,
            "op12_hard_negatives": oracles.OP12}
