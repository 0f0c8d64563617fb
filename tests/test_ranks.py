"""Positions and pages from range counts, against plain sorting."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loam.plans import paging
from loam.plans.ranks import PART, RankIndex


def texts(spark, n=4000, seed=3):
    """Two thirds of the rows in one key, a null key, null order values, ids that begin alike."""
    rng = random.Random(seed)
    data = [(rng.choices(["hot", "a", None], [66, 30, 4])[0], rng.choice([None, *"xyz"]), f"the-same-long-beginning-{i:07d}") for i in range(n)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, o string, id string").repartition(9)


def in_order(data, key):
    return sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1] or "", r[2]))


def test_positions_match_sorting(spark, rows):
    data, frame = texts(spark)
    got = RankIndex.build(frame, ["k"], ["o", "id"]).numbered("at")
    want = [(k, r[2], i + 1) for k in ("hot", "a", None) for i, r in enumerate(in_order(data, k))]
    assert got.columns == ["k", "o", "id", "at"] and rows(got, "k", "id", "at") == sorted(want, key=repr)


def test_a_hot_key_spans_parts(spark):
    """Parts are bounded by rows though every text begins alike."""
    _, frame = texts(spark)
    conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = RankIndex.build(frame, ["k"], ["o", "id"])
        sizes = [r["count"] for r in index.rows.groupBy(PART).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 1000
        assert index.ranges.where("k = 'hot'").count() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)


def test_a_page_reads_only_its_parts(spark, plan, tmp_path):
    data, frame = texts(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        RankIndex.build(frame, ["k"], ["o", "id"], str(tmp_path / "index"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    index = RankIndex.open(spark, str(tmp_path / "index"), ["k"])
    for key in ("hot", "a", None):
        want = in_order(data, key)
        for number in (1, 2, len(want) // 70 + 1, len(want)):
            page = index.page(number, 70, k=key)
            got = page.collect()
            assert [r["id"] for r in got] == [r[2] for r in want[(number - 1) * 70:number * 70]]
            assert all((r["total"], r["pages"]) == (len(want), -(-len(want) // 70)) for r in got)
    text = plan(index.page(20, 70, k="hot"))
    met = index.ranges.where("k = 'hot' and before < 1400 and before + n > 1330").count()
    assert len(index.rows.inputFiles()) == 8 and met <= 2
    pruned = [f for f in re.findall(r"PartitionFilters: \[(.*?)\], Push", text) if "_part" in f]
    assert [len(re.findall(r" = \d+|\d+(?=[,)])", re.sub(r"#\d+L?", "", f))) for f in pruned] == [met], text
    with pytest.raises(ValueError):
        index.page(1, 70)


def test_odd_tables(spark, rows):
    empty = spark.createDataFrame([], "k string, id int")
    index = RankIndex.build(empty, ["k"], ["id"])
    assert index.numbered().count() == 0 and index.page(1, 10, k="a").count() == 0
    assert paging.paged_lists(empty, ["k"], ["id"], F.col("id")).count() == 0
    same = spark.createDataFrame([("a", 1)] * 5, "k string, id int")
    assert [r["position"] for r in RankIndex.build(same, ["k"], ["id"]).numbered().orderBy("position").collect()] == [1, 2, 3, 4, 5]
    whole = RankIndex.build(spark.range(50).repartition(5), [], [F.desc("id")]).page(2, 20)
    assert [r["id"] for r in whole.collect()] == list(range(29, 9, -1))
    with pytest.raises(ValueError):
        RankIndex.build(same.withColumn(PART, F.lit(1)), ["k"], ["id"])
